"""Token counts with a shortcut for whole words: pre-tokens that are one token are counted without any merging."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glowtrace.llm.common import small_batches

#: Texts with more tokens than this are over the limit.
LIMIT = 2048
#: Words whose counts a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 500_000, 64

#: The pattern by which the vocabulary's own file cuts texts.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The pre-tokens of lower-case text in the alphabets below U+0250, as the vocabulary's own file cuts them.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Words with other characters than these are left to the library whole.
_UNSURE = re.compile(r"[^\x21-\x7eÀ-ÖØ-öø-ƿ]")
_SPECIAL = re.compile(rb"<\|(?:start|end)oftext\|>")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _checked(path: str) -> dict:
    """The vocabulary of a file that cuts and spells texts as ``_PIECE`` and the word ends here assume; others are refused."""
    file = json.load(open(path, encoding="utf-8"))
    model = file.get("model", {})
    normal = [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", [])]
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    cut = (splits[0].get("pattern") or {}).get("Regex")
    special = sorted(t.get("content") for t in file.get("added_tokens", []))
    same = normal == ["NFC", "Replace", "Lowercase"] and cut == _CUT and special == ["<|endoftext|>", "<|startoftext|>"]
    if not same or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        raise ValueError(f"{path} cuts texts in another way than this counter knows")
    return model["vocab"]


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's word-ending strings that, as the only pre-token of a text, the library encodes as one token.

    The proof tries each string once. It holds for any text, as pre-tokens are encoded one by one."""
    tokenizer = _tokenizer(path)
    vocabulary = _checked(path)
    words = [w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>")]
    # The vocabulary spells bytes as printable characters; strings of plain ASCII spell themselves.
    words = [w for w in words if w.isascii() and w == w.lower() and _PIECE.findall(w) == [w]]
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded, strict=True) if len(e.ids) == 1)


class Counter:
    """Token counts of texts. White space never falls inside a token, so a text's count is the sum over its words."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole = _tokenizer(path), whole
        self.known: dict[bytes, int] = {}

    def _learn(self, words: list[bytes]) -> dict[bytes, int]:
        counts, rest, owner = {}, [], []
        for word in words:
            counts[word] = 0
            text = word.decode("utf-8", "surrogatepass")
            if _SPECIAL.search(word) or _UNSURE.search(text):
                pieces = [text]
            else:
                pieces = _PIECE.findall(text.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(text))
            for piece in pieces:
                if piece in self.whole:
                    counts[word] += 1
                else:
                    rest.append(piece)
                    owner.append(word)
        for word, encoded in zip(owner, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            counts[word] += len(encoded.ids)
        return counts

    def __call__(self, texts: pd.Series) -> list[int]:
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        found: set[bytes] = set().union(*split)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = self._learn([w for w in found if w not in self.known])
        self.known |= {w: n for w, n in new.items() if len(w) <= LONGEST}
        known = self.known if all(len(w) <= LONGEST for w in new) else self.known | new
        return [sum(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def _counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def token_count(text: Column, df: DataFrame, path: str | None = None) -> Column:
    """Tokens of a text as the library gives them without added tokens; null counts as empty. ``path`` is the vocabulary's
    place on every executor."""
    path = path or vocabulary_path()
    whole = df.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))  # at most as many strings as the vocabulary has

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_counter(path, whole.value)(texts), dtype="int64")

    return count(text.cast("string"))


def document_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for documents (doc_id, text), rows as they come; null or empty text has 0 of
    each, null and repeated ids are kept as they are. A vocabulary file of another kind raises ValueError. Empty table: empty
    result."""
    small_batches(docs.sparkSession)
    counted = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col("text"), docs, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
