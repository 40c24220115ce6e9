"""BPE encoding by dynamic programming over prefixes, and decoding.

A word's encoding ends, for every prefix of the word, in one token that depends on the prefix alone. An
automaton of the vocabulary yields all tokens that end at a position; the right one is the token that is
compatible with the last token of the prefix before it. Two tokens are compatible if merging their joined text
would not join anything across their border: of the tokens that stand left and right of the border while the
two are built, no pair has a merge that comes before both go up into something larger. Following the
back-pointers from the whole word gives its ids exactly, in time linear in the word (times the longest token).

The normalising and splitting steps are those of the vocabulary file: NFC, white space to one space, lower case
letter by letter, words by pattern, bytes as printable letters, and an end-of-word mark on the last one. Special
tokens written in a text are special tokens. Texts are encoded whole; a null text is an empty one and gives no
tokens. Repeated rows are encoded each. Other columns come through unless they are called ``ids`` or
``decoded``, which are replaced. An empty table gives an empty result."""
from __future__ import annotations

import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Words whose encoding a worker keeps, in two generations, and the longest such word.
KEPT_WORDS, KEPT_LENGTH = 80_000, 64
_KEPT_PAIRS = 300_000
#: Characters of text that are encoded before rows are handed on.
STEP = 1 << 20
_NEVER = 1 << 60
_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """Printable letters for bytes: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary file of words with end marks, ready for encoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.specials).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # \s of the file means Unicode white space, which this engine calls by its property.
        self.pattern = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}"))
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.letters = [c for _, c in sorted(_byte_letters().items())]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = r
            self.halves[self.ids[a + b]] = (*pair, r)
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if self._reachable(i):
                text = name[:-len(_END)] + "\0" if name.endswith(_END) and len(name) > len(_END) else name
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _border(self, token: int, side: int) -> tuple:
        """Tokens at the right (side 1) or left (side 0) end while ``token`` is built, with the merge that ends each."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.halves:
                return tuple(out)
            until, token = self.halves[token][2], self.halves[token][side]

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge over the border of a and b comes first; equal merges go from left to right."""
        rights = self.right.get(a) or self.right.setdefault(a, self._border(a, 1))
        lefts = self.left.get(b) or self.left.setdefault(b, self._border(b, 0))
        for x, x_until in rights:
            for y, y_until in lefts:
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until and r < before:
                    return True
        return False

    def _reachable(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.halves:
                a, b, r = self.halves[t]
                if self._crossed(a, b, r):
                    return False
                todo += (a, b)
        return True

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > _KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = not self._crossed(a, b, _NEVER)
        return got

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as printable letters."""
        text = word + "\0"
        last = [-1] * (len(text) + 1)
        length = [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if length[end]:
                continue
            start = end - n
            if start == 0:
                last[end], length[end] = token, n
            elif (before := last[start]) >= 0:
                ok = pairs.get((before, token))
                if ok or ok is None and self.compatible(before, token):
                    last[end], length[end] = token, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= length[at]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            letters = self.letters
            got = np.array(self.encode_word("".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])), dtype="<u4").tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self.young) >= KEPT_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found: list[bytes] = []
        parts = self.special_pattern.split(text) if self.special_pattern and "<|" in text else [text]
        for part in parts:
            if part in self.specials:
                found.append(np.array([self.specials[part]], dtype="<u4").tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            get = self.young.get
            for w in self.pattern.findall(part.lower()):
                got = get(w)
                if got is None:
                    got = self._word(w)
                    get = self.young.get
                found.append(got)
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so tokens are joined by spaces as they are."""
        return " ".join([self.names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _slices(texts):
    """(first row, ids of the rows) for runs of rows of about ``STEP`` characters."""
    i = 0
    while i < len(texts):
        rows, size, first = [], 0, i
        while i < len(texts) and size < STEP:
            rows.append(texts[i].as_py() or "")
            size += len(rows[-1])
            i += 1
        yield first, rows


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """``docs`` without the text column, with ``ids`` (binary, little-endian unsigned 32-bit integers) and ``decoded``."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "ids", "decoded")]
    schema = StructType([*rest, StructField("ids", BinaryType()), *[StructField("decoded", StringType())] * decoded])
    kept = [f.name for f in rest]

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for first, rows in _slices(batch.column(batch.schema.get_field_index(text))):
                ids = [v.encode(s) for s in rows]
                part = batch.slice(first, len(ids))
                cols = [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array([v.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` made from the ids; a null is an empty text."""
    rest = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = StructType([*rest, StructField("decoded", StringType())])

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            out = pa.array([v.decode(x.as_py() or b"") for x in batch.column(at)], pa.string())
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in rest] + [out]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return encoded.select(*[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them.

    Encoding and decoding are one step, so a task holds one worker with one vocabulary, and only digests leave it."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for first, rows in _slices(batch.column(batch.schema.get_field_index("text"))):
                n, a, b = [], [], []
                for s in rows:
                    ids = v.encode(s)
                    n.append(len(ids) // 4)
                    a.append(sha(ids))
                    b.append(sha(v.decode(ids).encode("utf-8")))
                part = batch.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]))
