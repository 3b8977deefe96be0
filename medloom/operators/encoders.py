"""Text encoders as columns: a registry of backends, and one that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as T

DIMS, BATCH = 256, 64


@lru_cache(maxsize=200_000)
def _place(word: str, dims: int) -> tuple[int, int]:
    """Place and sign of a word: the first eight digits of its MD5 in base 16, and whether the ninth is 8 or more."""
    digits = hashlib.md5(word.encode("utf-8", "replace")).hexdigest()
    return int(digits[:8], 16) % dims, 1 if digits[8] >= "8" else -1


def _hashed(dims: int) -> Callable[[list[str]], np.ndarray]:
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                at, sign = _place(word, dims)
                row[at] += sign
        return out

    return encode


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the token vectors (texts, tokens, dims) that the mask (texts, tokens) keeps; zero where it keeps none."""
    weight = mask[..., None].astype(hidden.dtype)
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def onnx_backend(folder: str, most_tokens: int = 256, open_session=None) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A backend over a folder with model.onnx and tokenizer.json, as exported sentence or masked-language encoders have.

    Token vectors (the first output) are averaged over the attention mask. The folder must be one that all machines read.
    """

    def load() -> Callable[[list[str]], np.ndarray]:
        from tokenizers import Tokenizer

        if open_session is None:
            import onnxruntime

            session = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
        else:
            session = open_session(folder)
        tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        tokenizer.enable_truncation(most_tokens)
        tokenizer.enable_padding()
        wanted = {i.name for i in session.get_inputs()}

        def run(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros((0, 0), np.float32)
            found = tokenizer.encode_batch(texts)
            ids, mask = (np.array([getattr(e, a) for e in found], np.int64) for a in ("ids", "attention_mask"))
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return mean_pool(session.run(None, {k: v for k, v in given.items() if k in wanted})[0], mask)

        return run

    return load


#: Backend name -> function that loads a model (once a task) and gives texts -> matrix.
BACKENDS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {"hashing": lambda: _hashed(DIMS)}


def register(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    """Add a backend, e.g. one that loads a sentence encoder."""
    BACKENDS[name] = load


def encode(text: Column, backend: str = "hashing", normalise: bool = True, batch: int = BATCH) -> Column:
    """Vectors of texts with white space collapsed; null and blank texts are zero vectors. The model loads once a task."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}; known are {sorted(BACKENDS)}")
    load = BACKENDS[backend]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                made = np.asarray(model([t or "" for t in texts.iloc[at : at + batch]]), np.float32)
                if normalise:
                    length = np.linalg.norm(made, axis=1, keepdims=True)
                    made = made / np.where(length > 0, length, 1)
                rows.extend(made)
            yield pd.Series(rows, dtype=object)

    return run(T.collapse_spaces(text))


def model_tokens(text: Column, path: str) -> Column:
    """Tokens of a model's tokenizer (a tokenizer.json that all machines read), without special tokens; none for null and
    blank texts. The tokenizer loads once a task."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in batches:
            found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            yield pd.Series([e.tokens for e in found], dtype=object)

    return run(text)


def tokenize(text: Column, method: str = "simple", path: str | None = None) -> Column:
    """Tokens by a named method: 'simple' at white space, 'words' runs of word characters, 'model' those of a tokenizer."""
    if method == "model" and path:
        return model_tokens(text, path)
    made = {"simple": T.tokens, "words": T.words}
    if method not in made:
        raise ValueError(f"unknown method {method}; known are simple, words and, with a path, model")
    return made[method](T.text_or_empty(text))


def subwords(word: Column, shortest: int = 3, longest: int = 6) -> Column:
    """The word between angle brackets, and every stretch of ``shortest`` to ``longest`` characters of that."""
    whole = F.concat(F.lit("<"), word, F.lit(">"))

    def of(n: int) -> Column:
        # a stretch that would go beyond the end is none
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(whole) - n + 1)), lambda i: i <= F.length(whole) - n + 1)
        return F.transform(starts, lambda i: F.substr(whole, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(whole), *map(of, range(shortest, longest + 1))))


def mean_of_subwords(docs: DataFrame, key: str, text: str, vectors: DataFrame, dims: int, shortest: int = 3, longest: int = 6) -> DataFrame:
    """(key, vector): as mean_of_words, with a word's vector the mean of its known subwords' of a table (word, vector)
    that has '<word>' and character stretches; so words the table doesn't know have one too."""
    words = docs.select(key, F.explode(T.tokens(T.collapse_spaces(F.lower(F.col(text))))).alias("word"))
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.select("word").distinct().select("word", F.explode(subwords(F.col("word"), shortest, longest)).alias("part"))
    known = parts.join(vectors.select(F.col("word").alias("part"), "vector"), "part")
    own = known.groupBy("word").agg(F.array(*[F.avg(F.col("vector")[i]).cast("double") for i in range(dims)]).alias("vector"))
    sums = counted.join(own, "word").groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.col("vector")[i] * F.col("n")).alias(f"s{i}") for i in range(dims)])
    mean = sums.select(key, F.array(*[(F.col(f"s{i}") / F.col("n")).cast("float") for i in range(dims)]).alias("vector"))
    zero = F.array(*[F.lit(0.0).cast("float")] * dims)
    return docs.select(key).join(mean, key, "left").withColumn("vector", F.coalesce("vector", zero))


def mean_of_words(docs: DataFrame, key: str, text: str, vectors: DataFrame, dims: int) -> DataFrame:
    """(key, vector): the mean of the known words' vectors of a table (word, vector); a zero vector without any.

    The word table is joined, so it may be larger than a task's memory."""
    words = docs.select(key, F.explode(T.tokens(T.collapse_spaces(F.lower(F.col(text))))).alias("word"))
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n")).join(vectors.select("word", "vector"), "word")
    sums = counted.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.col("vector")[i] * F.col("n")).alias(f"s{i}") for i in range(dims)])
    mean = sums.select(key, F.array(*[(F.col(f"s{i}") / F.col("n")).cast("float") for i in range(dims)]).alias("vector"))
    zero = F.array(*[F.lit(0.0).cast("float")] * dims)
    return docs.select(key).join(mean, key, "left").withColumn("vector", F.coalesce("vector", zero))
