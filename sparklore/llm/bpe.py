"""Byte-pair encoding: exact merges by backtracking (op 1) and token counts by a heap of pairs (op 9).

The vocabulary comes from a public tokenizer file (``*.json``, byte-level BPE), whose path is a
parameter. The driver reads it once and ships its text, a fixed size, to the tasks. Nothing here calls a
tokenizer library.

Texts are cut in two steps: at blanks into pieces of a space and a run without blanks, which never
cut a pre-token, and each piece seen for the first time into the tokenizer's pre-tokens. Pieces repeat
a lot, so each task keeps a table of pieces it has met (``KEPT`` entries at most, then it starts anew;
that costs time, never results).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import of_worker, texts_of, with_arrow

KEPT = 100_000
#: The same for pre-tokens.
KEPT_PRE_TOKENS = 250_000
#: The same for pairs of tokens known to be compatible or not.
KEPT_PAIRS = 250_000
#: Size of these tables, as a multiple, where digests are made: no ids leave the task, so its worker has room for them.
DIGEST_TABLES = 3.0
#: Pieces longer than this are not kept in the table of known pieces.
KEPT_LENGTH = 64

# Fixed values of byte-level tokenizer files: the characters that stand for bytes in token strings.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# Fixed value: the pre-token pattern of byte-level tokenizer files; {s}, {L}, {N} stand for character ranges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{s}{L}{N}]+|[{s}]+(?![^{s}])|[{s}]+"
# Fixed value: Unicode white space (not the separators 1C to 1F, which Python's \s has too).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEVER = 1 << 60


def byte_of_char() -> dict[str, int]:
    """Token files write each byte as one printable character; the other bytes get characters from U+0100 on."""
    table = {chr(b): b for b in _PRINTABLE}
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return table | {chr(0x100 + i): b for i, b in enumerate(rest)}


# Letters and numbers of Unicode 16, which the tokenizer library knows and Python 3.13 does not.
NEWER = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
          (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
          (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
          (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
          (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
          (0x1E5F1, 0x1E5FA)],
}


def ranges_of(kind: str) -> str:
    """The characters of a Unicode category group ("L", "N") as ranges for a regular expression."""
    out, start = [], None
    newer = {c for a, b in NEWER[kind] for c in range(a, b + 1)}
    for c in range(0x110001):
        inside = c < 0x110000 and (unicodedata.category(chr(c))[0] == kind or c in newer)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Vocabulary:
    """Tokens as byte strings (written in Latin-1), merge ranks and the tables of both methods."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, to_byte = spec["model"], byte_of_char()
        if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("end_of_word_suffix"):
            raise ValueError("only byte-level BPE files are supported")

        def plain(token: str) -> str:
            return "".join(chr(to_byte[c]) for c in token)

        self.id_of = {plain(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank_of: dict[tuple[str, str], int] = {}   # pair of tokens -> rank of their merge
        self.parts: dict[str, tuple[str, str]] = {}     # token -> the pair it is made of
        for rank, (a, b) in enumerate(pairs):
            a, b = plain(a), plain(b)
            self.rank_of.setdefault((a, b), rank)
            self.parts.setdefault(a + b, (a, b))
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.text_of = [b""] * size
        for t, i in self.id_of.items():
            self.text_of[i] = t.encode("latin-1")
        for t, i in self.special.items():
            self.text_of[i] = t.encode()
        # The offset table of decoding: token i is bytes[starts[i]:starts[i] + lengths[i]].
        self.lengths = np.array([len(t) for t in self.text_of], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.text_of), dtype=np.uint8)
        self._special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        self._coarse = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self._fine = re.compile(PRE_TOKEN.format(s=_SPACE, L=ranges_of("L"), N=ranges_of("N")))
        # Made at the first use; tokens are then numbered by their ids.
        self._compatible: dict[int, bool] = {}
        self.most_pairs = KEPT_PAIRS
        self._alone: dict[str, bool] = {}
        self._automaton = None

    # ---- cutting -------------------------------------------------------------------------------

    def parts_of(self, text: str) -> list[str | int]:
        """The text between special tokens, and the ids of those tokens."""
        if self._special is None or not self._special.search(text):
            return [text]
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [text[at:m.start()], self.special[m.group()]]
            at = m.end()
        return [x for x in [*out, text[at:]] if x != ""]

    def pieces(self, text: str) -> list[str]:
        return self._coarse.findall(text)

    def pre_tokens(self, piece: str) -> list[str]:
        return self._fine.findall(piece)

    # ---- encoding by backtracking ----------------------------------------------------------------

    def _rank_made(self, token: str) -> int:
        return self.rank_of[self.parts[token]] if token in self.parts else -1

    def compatible(self, a: str, b: str) -> bool:
        """True if merging the bytes of ``a`` and ``b`` by rank gives just these two tokens.

        Follows the two tokens at the border as they grow: on the left the last part of ``a``, on
        the right the first part of ``b``. A merge across the border must never come first.
        """
        left, right = [a], [b]
        while left[-1] in self.parts:
            left.append(self.parts[left[-1]][1])
        while right[-1] in self.parts:
            right.append(self.parts[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            across = self.rank_of.get((left[i], right[j]), NEVER)
            grow_left = self._rank_made(left[i - 1]) if i else NEVER
            grow_right = self._rank_made(right[j - 1]) if j else NEVER
            if across < grow_left and across <= grow_right and across < NEVER:
                return False
            if not i and not j:
                return True
            if grow_left <= grow_right:
                i -= 1
            else:
                j -= 1

    def _pair(self, a: int, b: int) -> bool:
        """``compatible`` for ids, entered in the table of pairs."""
        if len(self._compatible) > self.most_pairs:
            self._compatible.clear()
        known = self._compatible[a << 32 | b] = self.compatible(self._token[a], self._token[b])
        return known

    def alone(self, token: str) -> bool:
        """True if merging the bytes of ``token`` by rank gives the token itself."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = token not in self.parts or merge_by_heap(token, self.rank_of) == [token]
        return known

    def prepare(self) -> None:
        """The automaton of all tokens, and of each token its longest shorter token with the same start."""
        usable = {t: i for t, i in self.id_of.items() if self.alone(t)}
        self._token = {i: t for t, i in usable.items()}
        self._size = self.lengths.tolist()
        self._shorter = [-1] * len(self.text_of)
        automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            automaton.add_word(t, i)
            self._shorter[i] = next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), -1)
        automaton.make_automaton()
        self._automaton = automaton

    def encode_pre_token(self, s: str) -> list[int]:
        """Ids of one pre-token (bytes as Latin-1): longest matches, given up one by one where pairs clash."""
        if self._automaton is None:
            self.prepare()
        whole = self.id_of.get(s)
        if whole is not None and whole in self._token:
            return [whole]
        n, size, shorter, pair_known = len(s), self._size, self._shorter, self._compatible.get
        longest = [-1] * n
        for end, t in self._automaton.iter(s):
            longest[end - size[t] + 1] = t      # later matches with the same start are longer
        dead = set()                            # positions from which no encoding goes on
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                if not dead or at + size[token] not in dead:
                    if last < 0:
                        break
                    good = pair_known(last << 32 | token)
                    if good or good is None and self._pair(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                last, token = token, longest[at] if at < n else -1
                continue
            dead.add(at)
            if not out:
                raise ValueError("a byte of the text is not in the vocabulary")
            token = out.pop()
            at -= size[token]
            token, last = shorter[token], out[-1] if out else -1
        return out

    # ---- decoding ----------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids, gathered through the offset table."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


def merge_by_heap(s: str, rank_of: dict[tuple[str, str], int]) -> list[str]:
    """All merges of ``s`` by a heap of adjacent pairs over a linked list; the symbols that remain."""
    symbols, _ = _merged(s, rank_of)
    return [x for x in symbols if x]


def count_by_heap(s: str, rank_of: dict[tuple[str, str], int]) -> int:
    """Initial symbols less merges."""
    return len(s) - _merged(s, rank_of)[1]


def _merged(s: str, rank_of: dict[tuple[str, str], int]) -> tuple[list[str], int]:
    n = len(s)
    symbols = list(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = rank_of.get
    heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank((s[i], s[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue                             # one of the two has been merged since
        new = a + b
        symbols[i], symbols[j] = new, ""
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank((new, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, new, symbols[k]))
        h = before[i]
        if h >= 0 and (r := rank((symbols[h], new))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], new))
    return symbols, merges


class Known(dict):
    """Pieces met so far and what was made of them; starts anew when full."""

    def __init__(self, make, most):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, piece):
        made = self._make(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= self._most:
                self.clear()
            self[piece] = made
        return made


class Encoder:
    """Ids of whole texts, from tables of pieces and of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, tables: float = 1.0):
        self.v = vocabulary
        vocabulary.most_pairs = int(KEPT_PAIRS * tables)
        # Packed: a few bytes per entry instead of a list of numbers.
        self.pre_tokens = Known(lambda p: array("i", vocabulary.encode_pre_token(p.encode().decode("latin-1"))).tobytes(),
                                int(KEPT_PRE_TOKENS * tables))
        self.known = Known(self._make, int(KEPT * tables))

    def _make(self, piece: str) -> tuple[str, bytes]:
        packed = b"".join(map(self.pre_tokens.__getitem__, self.v.pre_tokens(piece)))
        return ",".join(map(str, array("i", packed))), packed

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """Decimal ids joined by commas, and the ids."""
        written, packed = [], []
        for part in self.v.parts_of(text):
            if isinstance(part, int):
                written.append(str(part))
                packed.append(array("i", [part]).tobytes())
            elif part:
                made = [*map(self.known.__getitem__, self.v.pieces(part))]
                written += [x[0] for x in made]
                packed += [x[1] for x in made]
        return ",".join(written), np.frombuffer(b"".join(packed), dtype=np.int32)


class Counter:
    """Token counts of whole texts, from tables of pieces and of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        rank_of = vocabulary.rank_of
        self.pre_tokens = Known(lambda p: count_by_heap(p.encode().decode("latin-1"), rank_of),
                                KEPT_PRE_TOKENS)
        self.known = Known(lambda piece: sum(map(self.pre_tokens.__getitem__, vocabulary.pre_tokens(piece))), KEPT)

    def count(self, text: str) -> int:
        return sum(1 if isinstance(part, int) else sum(map(self.known.__getitem__, self.v.pieces(part)))
                   for part in self.v.parts_of(text))


def _worker(kind, source: str, *args):
    """One per Python worker and vocabulary: workers serve many tasks, and keep their table of pieces."""
    return of_worker((kind.__name__, hashlib.sha256(source.encode()).hexdigest(), args), lambda: kind(Vocabulary(source), *args))


def _shipped(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", check: str | None = None, tables: float = 1.0) -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new column ``ids`` (array of int).

    Null counts as the empty text, which has no ids. Strings of special tokens inside a text become
    their ids. ``check`` names one more column: does decoding the ids in the same task give the text back? ``tables``: size
    of the tables of known pieces as a share of the usual one, for workers with less memory. Columns of ``docs`` with these names are replaced. Rows are never merged or dropped.
    """
    source = _shipped(docs, tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        encoder = _worker(Encoder, source.value, tables)
        texts = texts_of(batch.column(0))
        rows = [encoder.encode(t)[1] for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]))
        made = {ids: pa.ListArray.from_arrays(pa.array(ends), flat)}
        if check:
            made[check] = pa.array([encoder.v.decode(r) == t.encode() for r, t in zip(rows, texts)], pa.bool_())
        return made

    new = {ids: "array<int>"} | ({check: "boolean"} if check else {})
    return with_arrow(docs, run, new, [text], [c for c in docs.columns if c not in new], state=True)


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with column ``text`` made from the token ids.

    Bytes that are no valid UTF-8 become U+FFFD; null ids give a null text, no ids an empty one. Ids
    outside the vocabulary, and null ones, are skipped.
    """
    source = _shipped(docs, tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        v = _worker(Encoder, source.value).v
        out = []
        for row in batch.column(0).to_pylist():
            if row is None:
                out.append(None)
                continue
            good = np.array([i for i in row if i is not None and 0 <= i < len(v.text_of)], dtype=np.int64)
            out.append(v.decode(good).decode("utf-8", "replace"))
        return {text: pa.array(out, pa.string())}

    return with_arrow(docs, run, {text: "string"}, [ids], [c for c in docs.columns if c != text], state=True)


def digests(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and, of the encoded and decoded text: n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes like ``encode`` and ``decode``, without moving the ids out of the task.
    """
    source = _shipped(docs, tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        encoder = _worker(Encoder, source.value, DIGEST_TABLES)
        n, a, b = [], [], []
        for t in texts_of(batch.column(0)):
            written, row = encoder.encode(t)
            n.append(len(row))
            a.append(hashlib.sha256(written.encode()).hexdigest())
            b.append(hashlib.sha256(encoder.v.decode(row).decode("utf-8", "replace").encode()).hexdigest())
        return {"n": pa.array(n, pa.int64()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())}

    return with_arrow(docs, run, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"},
                      [text], keep, state=True)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of ``text``.

    Null counts as the empty text: no bytes, no tokens, not over the limit. Columns of ``docs`` with
    these names are replaced. No ids are made.
    """
    source = _shipped(docs, tokenizer)
    new = {"n_bytes": "long", "n_tokens": "long"}

    def run(batch: pa.RecordBatch) -> dict:
        counter = _worker(Counter, source.value)
        texts = texts_of(batch.column(0))
        return {"n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64())}

    keep = [c for c in docs.columns if c not in (*new, "over_limit")]
    return with_arrow(docs, run, new, [text], keep, state=True).withColumn("over_limit", F.col("n_tokens") > limit)
