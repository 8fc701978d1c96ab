"""Exact token counts of every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

A run of tokens is what the merges give for its bytes exactly when every two neighbours in it
are what the merges give for theirs. So every prefix of a piece has one last token that fits
the last token of the shorter prefix before it, and

    count[end] = count[start of that token] + 1.

Tokens that end at a place come from an automaton over the vocabulary (Aho-Corasick), and
whether two tokens fit is looked up in a table that fills as pairs are met. One pass over a piece
gives the counts of all its prefixes, in time linear in its length.

The vocabulary's pattern cuts texts into pieces, and a prefix is cut like a text of its own:

* white space before a word is one run as long as the word has not begun;
* ``'re``, ``'ve`` and ``'ll`` are two pieces until their last letter stands there;
* a special token is ordinary text until its last character stands there, and parts the text around it.

The table of a text answers how many tokens any of its prefixes has, which is the longest prefix
within a budget, and so on, without encoding again (``tokens_of``, ``longest_within``).

Null text counts as empty and has no tokens. Texts of any length are read whole; equal rows give
equal counts; an empty table gives no rows. Rows are independent, nothing is shuffled, and what is
kept beside a text is its table and a bounded memory of pieces. The vocabulary (a parameter, some
megabytes) is read once on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import read

__all__ = ["PrefixTable", "prefix_counts", "longest_within", "tokens_of", "counted", "op12"]

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
# The pattern of pieces and the two white-space classes of the vocabulary's public description.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATE = {"'re", "'ve", "'ll"}
KEEP_PIECE = 200  # characters of a piece whose table is kept
KEEP_PIECES = 300_000  # of each of two generations
KEEP_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others in order from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class PrefixTable:
    """Counts of prefixes under one vocabulary file of byte-level BPE."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        simple = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not (
            before.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"))
        if not simple:
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        narrow = {ord(k): chr(v) for k, v in letters.items()}
        number = {t.translate(narrow): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.ranks: dict[int, int] = {}
        # When a token is made, and of which two; bytes are there from the start.
        self.made = {i: (-1, -1, -1) for t, i in number.items() if len(t) == 1}
        for rank, merge in enumerate(model["merges"]):
            left, right = (part.translate(narrow) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = number[left + right]
            if whole in self.made:
                raise ValueError("two merges give one token")
            self.made[whole] = rank, number[left], number[right]
            self.ranks[number[left] << 32 | number[right]] = rank
        self.automaton = ahocorasick.Automaton()
        for token, i in number.items():
            if i in self.made:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = regex.compile(PIECES)
        self.runs = regex.compile(r"\s{2,}")
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge older than ``before`` joins the ends of two tokens.

        Merges are taken back, the latest first: the pair that stood at the seam at that time must not
        have been one that merges earlier. Of equal merges the one on the left comes first.
        """
        ranks, made = self.ranks, self.made
        while ranks.get(left << 32 | right, before) >= before:
            a, b = made[left], made[right]
            if a[0] > b[0]:
                before, left = a[0], a[2]
            elif b[0] >= 0:
                before, right = b[0] + 1, b[1]
            else:
                return True
        return False

    def whole(self, token: int) -> bool:
        """Whether the merges give this token for its own bytes."""
        rank, left, right = self.made[token]
        return rank < 0 or self.fit(-1, left) and self.fit(-1, right) and self.apart(left, right, rank)

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens as they are when they follow one another (-1: nothing before)."""
        key = left << 32 | right if left >= 0 else -right - 1
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= KEEP_PAIRS:
                self.fits.clear()
            found = self.fits[key] = self.whole(right) if left < 0 else self.fit(-1, right) and self.apart(left, right, 1 << 60)
        return found

    def piece(self, piece: str) -> list[int]:
        """Counts of the prefixes of a piece that has tokens of its own; one number per character."""
        coded = piece.encode()
        n = len(coded)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        known, fit = self.fits, self.fit
        for end, (length, token) in self.automaton.iter(coded.decode("latin-1")):
            end += 1
            if count[end]:
                continue
            start = end - length
            left = last[start]
            if start and left < 0:
                continue
            ok = known.get(left << 32 | token if left >= 0 else -token - 1)
            if fit(left, token) if ok is None else ok:
                last[end], count[end] = token, count[start] + 1
        if n != len(piece):
            # Bytes that begin a character end the one before.
            counts = [count[i] for i in range(1, n) if coded[i] & 0xC0 != 0x80]
            counts.append(count[n])
        else:
            counts = count[1:]
        if piece in LATE:
            counts[1] = 2
        return counts

    def entry(self, piece: str) -> bytes:
        """Packed counts of a piece; those of short pieces are kept for a while."""
        found = self.earlier.get(piece) or array("i", self.piece(piece)).tobytes()
        if len(piece) <= KEEP_PIECE:
            if len(self.known) >= KEEP_PIECES:
                # Pieces met again move from the earlier generation to the new one.
                self.earlier, self.known = self.known, {}
            self.known[piece] = found
        return found

    def ordinary(self, text: str) -> np.ndarray:
        """Counts of all prefixes (the empty one first) of a text without special tokens."""
        counts = np.zeros(len(text) + 1, np.int32)
        pieces = self.pieces.findall(text)
        if not pieces:
            return counts
        entry = self.entry
        packed = np.frombuffer(b"".join([self.known.get(p) or entry(p) for p in pieces]), np.int32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        totals = packed[np.cumsum(lengths) - 1]
        counts[1:] = packed + np.repeat(np.cumsum(totals) - totals, lengths)
        for run in self.runs.finditer(text):
            # White space is cut before its last character only once something follows it.
            a, b = run.span()
            if b < len(text):
                counts[b] = counts[a] + self.piece(run[0])[-1]
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Tokens of each of the ``len(text) + 1`` prefixes."""
        parts, base, start = [], 0, 0
        for found in self.special.finditer(text) if self.special else ():
            part = self.ordinary(text[start: found.end() - 1]) + base
            base = int(part[found.start() - start]) + 1
            parts.append(part)
            start = found.end()
        parts.append(self.ordinary(text[start:]) + base)
        return np.concatenate(parts)


_tables: dict[bytes, PrefixTable] = {}


def table(content: bytes) -> PrefixTable:
    """One table per worker and vocabulary."""
    name = hashlib.sha256(content).digest()
    if name not in _tables:
        _tables.clear()
        _tables[name] = PrefixTable(content)
    return _tables[name]


def _vocabulary(documents: DataFrame, path: str | None):
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        return documents.sparkSession.sparkContext.broadcast(file.read())


def prefix_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Input columns and ``_counts``, an int for each prefix of ``text`` from the empty one to the whole."""
    content = _vocabulary(documents, path)
    columns = documents.columns

    def run(batches):
        counter = table(content.value)
        for batch in batches:
            for i in range(batch.num_rows):
                # Row by row, so that no more than one table of a long text is held at once.
                row = batch.slice(i, 1)
                counts = counter.counts(row.column("text")[0].as_py() or "")
                yield pa.RecordBatch.from_arrays([*row.columns, pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int32()))], [*columns, "_counts"])
    schema = documents.withColumn("_counts", F.lit(None).cast("array<int>")).schema
    return documents.mapInArrow(run, schema)


def tokens_of(counts: Column, chars: Column | int) -> Column:
    """Tokens of the prefix of so many characters; null beyond the text."""
    return F.get(counts, F.lit(chars) if isinstance(chars, int) else chars)


def longest_within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(counts, i) <= budget))


def counted(documents: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, fit_chars)``; ``fit_chars`` is the length of the longest prefix within the limit."""
    content = _vocabulary(documents, path)

    def run(batches):
        counter = table(content.value)
        for batch in batches:
            tokens, fit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                counts = counter.counts(text.as_py() or "")
                tokens[i] = counts[-1]
                fit[i] = len(counts) - 1 if counts[-1] <= limit else np.flatnonzero(counts <= limit)[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_bytes"), pa.array(tokens), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "fit_chars"])
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes")
    return documents.select("doc_id", size, "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")


def op12(spark, sf_dir: str) -> DataFrame:
    return counted(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
