"""Token counts with a whole-token shortcut.

A vocabulary of BPE with word ends knows many pre-tokens whole. Which ones is proved beforehand: every vocabulary string
with the word end is put to the library's own model as a pre-token, and it counts if exactly its one id comes back. In
the texts these pre-tokens count one token each by a look in that set; only the rest is merged, by the library's model.
The normalizer turns white space to blanks and the pre-tokenizer never joins over it, so a text is counted by its
blank-separated parts, and parts seen before are not taken apart again.

A text of proved characters alone (below U+0300, where the normalizer does to each character what lower-casing does, and
white space is what Python splits at) needs no normalizer; others go through the library's. Strings of added tokens in a
text count one token each, as is the library's default, and cut the text, as they do there.

Null texts are empty: no bytes, no tokens. Rows repeat as they come, those of null ids too. An empty table gives an empty
result. Columns other than doc_id and text are not read, names that differ from these in case alone included.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keep_only

#: Marks that end many parts.
MARKS = ".,;:!?"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Parts whose counts a task remembers, and the longest that it remembers; characters that are tried.
CACHE, LONGEST, TRIED = 300_000, 64, 0x300


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens, as the pre-tokenizer writes them, that the model gives back as one token."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    model, end = Tokenizer.from_file(path).model, spec["end_of_word_suffix"]
    held = [(t[: -len(end)], i) for t, i in spec["vocab"].items() if t.endswith(end) and t != end]
    return frozenset(s for s, i in held if [x.id for x in model.tokenize(s)] == [i])


def plain_characters(path: str) -> str:
    """Characters that the normalizer only lower-cases, and blanks that it and Python alike split at."""
    from tokenizers import Tokenizer

    normal = Tokenizer.from_file(path).normalizer.normalize_str
    kept = []
    for c in map(chr, range(TRIED)):
        if c.isspace():
            good = normal(f"a{c}b") == "a b"
        else:
            good = normal(f"a{c}b") == f"a{c.lower()}b" and normal(c) == c.lower()
        if good:
            kept.append(c)
    return "".join(kept)


class Counter:
    """Tokens of whole texts, with the library's file at ``path``."""

    def __init__(self, path: str, whole: frozenset[str], plain: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at what stands around them are not known here")
        self.normal, self.parts, self.model = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        self.whole, self.other = whole, re.compile(f"[^{re.escape(plain)}]")
        self.seen: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def of_part(self, part: str) -> int:
        """Tokens of a part between blanks, lower case already."""
        word = part.rstrip(MARKS)
        if word.isascii() and word.isalpha():  # letters, then marks: one pre-token each, written as they stand
            pre = [word, part[len(word) :]] if len(word) < len(part) else [word]
        else:
            pre = [p for p, _ in self.parts(part)]
        n = 0
        for p in pre:
            if p in self.whole:
                n += 1
            else:
                if (k := self.merged.get(p)) is None:
                    k = len(self.model.tokenize(p))
                    self._remember(self.merged, p, k)
                n += k
        return n

    @staticmethod
    def _remember(counts: dict[str, int], key: str, n: int) -> None:
        if len(key) <= LONGEST:
            if len(counts) >= CACHE:
                counts.clear()
            counts[key] = n

    def of_words(self, words: list[str], lower: bool) -> int:
        seen, n = self.seen, 0
        for w in words:
            if (k := seen.get(w)) is None:
                k = self.of_part(w.lower() if lower else w)
                self._remember(seen, w, k)
            n += k
        return n

    def of_text(self, text: str) -> int:
        if not (marks := len(self.added.findall(text))):
            return self._plain(text)
        return marks + sum(self._plain(t) for t in self.added.split(text))

    def _plain(self, text: str) -> int:
        if not self.other.search(text):
            return self.of_words(text.split(), True)
        # parts are normal now: a capital that is left has no lower case, so the same part has the same count
        return self.of_words([w for w in self.normal(text).split(" ") if w], False)


def _count(path: str, known, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, *known.value)
        for batch in batches:
            n_bytes = batch.column("text").cast(pa.binary()).to_pylist()
            tokens = np.array([counter.of_text(t) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b or b"") for b in n_bytes], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return count


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row. tokenizer: a file of the tokenizers library, BPE with word ends.

    The set of whole tokens is no larger than the vocabulary, so it is broadcast.
    """
    known = docs.sparkSession.sparkContext.broadcast((whole_tokens(tokenizer), plain_characters(tokenizer)))
    return keep_only(docs, doc_id="long", text="string").mapInArrow(_count(tokenizer, known, limit), SCHEMA)
