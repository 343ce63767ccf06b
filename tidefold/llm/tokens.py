"""Op 5, token counts by the whole-token shortcut, and the tokenisation that packing shares.

Which vocabulary strings encode alone as one token is proved once on the driver by merging each of
them (``Vocabulary.proved``). A text is cut at places where the pre-tokeniser cuts in any context:
before a single space that a non-space follows, and around a newline between non-spaces. Each piece is
looked up; a new piece is split into pre-tokens by the vocabulary's pattern, pre-tokens that are
proved whole tokens are taken as they are, and only the rest is merged. Texts with other runs of
white space are cut by the pattern as a whole; texts with a special token's string go to the
library, which splits them there first.

Null text counts as empty (0 tokens); empty tables give empty results; columns other than doc_id and
text are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in each of the two generations that one Python worker keeps; a full one replaces the older.
CACHE_PIECES = 300_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Unsafe(Exception):
    """The text can't be cut at its spaces."""


class Vocabulary:
    """A byte-level BPE vocabulary with its merges; built from a tokenizers JSON text."""

    def __init__(self, source: str):
        data = json.loads(source)
        model, letters = data["model"], {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(letters[c] for c in s)
        self.source = source
        self.special = [t["content"] for t in data["added_tokens"]]
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = i
        self.pattern = regex.compile(PATTERN)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is merged until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.rank
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = 1 << 60, -1
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap over linked parts, for pre-tokens of any length."""
        import heapq

        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] == a else n
            if j >= n or parts[j] != b or not a:
                continue
            parts[i], parts[j] = a + b, b""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ids[p] for p in parts if p]

    def compiled(self):
        """The same merges as compiled code, where ids follow the order of the merges; else None."""
        if any(self.ids.get(a + b, -1) != 256 + i for (a, b), i in self.rank.items()):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})._core_bpe

    def proved(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and merge to one token, with their ids."""
        out = {}
        for raw, i in self.ids.items():
            try:
                s = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.pattern.findall(s) == [s] and self.merge(raw) == [i]:
                out[s] = i
        return out


class Encoder:
    """Packed little-endian ids of texts, by the shortcut; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary, whole: dict[str, int]):
        self.v, self.library = vocabulary, None
        self.special, self.core = vocabulary.special, vocabulary.compiled()
        one = {s: struct.pack("<I", i) for s, i in whole.items()}
        self.newline = one.get("\n") or self._pack(vocabulary.merge(b"\n"))
        pieces, merged = self._pieces, self._merged

        class Pieces(dict):
            """Packed ids of pieces with ``lead`` before them; the least bit of method for a new one."""

            def __init__(self, lead: str):
                super().__init__()
                self.lead, self.old = lead, {}

            def __missing__(self, part: str) -> bytes:
                out = self.old.get(part)
                if out is not None:
                    self[part] = out
                    return out
                if not part or part[0].isspace() or part[-1].isspace():
                    raise _Unsafe
                if part.isalpha():
                    x = self.lead + part
                    out = one.get(x) or merged(x.encode())
                elif part[-1] in ",.!?;:" and part[:-1].isalpha():
                    out = self[part[:-1]] + one[part[-1]]
                    if len(part) > 5:
                        return out
                else:
                    out = pieces(self.lead + part)
                if len(part) < 64:
                    if len(self) >= CACHE_PIECES:
                        self.old = dict(self)
                        self.clear()
                    self[part] = out
                return out

        self.after, self.first, self.one = Pieces(" "), Pieces(""), one

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> bytes:
        one, out = self.one, []
        for x in self.v.pattern.findall(text):
            out.append(one.get(x) or self._merged(x.encode()))
        return b"".join(out)

    def _merged(self, piece: bytes) -> bytes:
        return self._pack(self.core.encode_single_piece(piece) if self.core else self.v.merge(piece))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for s in self.special:
            if s in text:
                if self.library is None:
                    from tokenizers import Tokenizer

                    self.library = Tokenizer.from_str(self.v.source)
                    self.library.no_truncation()
                    self.library.no_padding()
                return self._pack(self.library.encode(text, add_special_tokens=False).ids)
        after, first, out = self.after.__getitem__, self.first, []
        try:
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                out.append(first[head] + b"".join(map(after, rest)))
            return self.newline.join(out)
        except _Unsafe:
            return self._pieces(text)


_ENCODERS: dict[int, Encoder] = {}
_PROVED: dict[str, tuple[Vocabulary, dict[str, int]]] = {}


def encoder(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """Reads and proves the vocabulary on the driver; returns what makes an encoder on a worker.

    What is broadcast is the vocabulary file and the list of proved strings: a few MB for any corpus."""
    if path not in _PROVED:
        with open(path, encoding="utf-8") as f:
            v = Vocabulary(f.read())
        _PROVED[path] = v, v.proved()
    v, whole = _PROVED[path]
    sent = spark.sparkContext.broadcast((v.source, whole))
    key = hash((v.source, len(whole)))

    def get() -> Encoder:
        if key not in _ENCODERS:
            source, known = sent.value
            _ENCODERS[key] = Encoder(Vocabulary(source), known)
        return _ENCODERS[key]

    return get


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; one pass, no shuffle."""
    make = encoder(docs.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for batch in batches:
            texts = batch.column(1)
            n = [len(enc.encode(t.as_py())) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
