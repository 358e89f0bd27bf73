"""BPE encoding by backtracking, decoding by an offset table (operator 2).

Encoding. A word is covered from the left: an Aho-Corasick search finds the
longest vocabulary entry that matches where the last token ended (every byte
symbol is an entry, so one does); it stays if it is *compatible* with that token,
else fall back to the next shorter entry with the same start, else undo the last
token. Positions that turned out to be dead ends are never tried again, so the
work is linear in the word. Two tokens are compatible when byte-pair merging of
their concatenation would leave the boundary between them; a token sequence is
the result of merging exactly if all its neighbours are compatible. The pair
table is filled when a pair is first met.

Splitting. The vocabulary's own normaliser and splitter (part of the tokenizer
file) turn text into words. They never join anything across blanks, so they run
once per distinct blank-separated chunk.

Decoding. All token strings lie in one buffer; ``offsets[i]:offsets[i + 1]`` is
token i. A document's ids are turned to bytes with one gather from the buffer.

Null and empty texts have no tokens and decode to the empty string. Repeated
rows are encoded alike. A chunk or text of any length is encoded whole; chunks
over ``KEEP_CHARS`` characters are just not remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewire.llm._store import release, ship

#: Bounds of a worker's memories of words and of chunks: entries of a generation, and the longest string kept.
KEEP, KEEP_CHARS = 200_000, 48
#: Pairs remembered by the compatibility table before it starts afresh.
KEEP_PAIRS = 300_000
#: Chunks of these characters are their own normal form but for case, and split as PLAIN_WORDS says;
#: all others go through the tokenizer file's normaliser and splitter.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The normaliser and splitter that PLAIN_WORDS restates.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a word; a private-use character that byte symbols never are.
END = ""


class Merges:
    """What byte-pair merging does to one word, answered by backtracking."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        import ahocorasick

        short = (lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t) if suffix else (lambda t: t)
        self.end = END if suffix else ""
        self.id = {short(t): i for t, i in vocabulary.items()}
        self.rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.merged: dict[tuple[str, str], int] = {}
        for at, (left, right) in enumerate(merges):
            left, right = short(left), short(right)
            whole = left + right
            self.merged.setdefault((left, right), at)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), at
        self.units = {t for t in self.id if t not in self.parts}
        self.trie = ahocorasick.Automaton()
        for t in self.id:
            self.trie.add_word(t, t)
        self.trie.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` keeps the boundary between the two."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._boundary_stays(left, right)
        return found

    def _boundary_stays(self, left: str, right: str) -> bool:
        # Run the merges of the two sides backwards. At any time `left` and `right` are the
        # pieces that touch the boundary; they existed together until the earlier of the
        # merges that consumed them (`until`, with the left side going first at equal rank).
        rank, parts = self.rank, self.parts
        until = (len(self.merged) + 1, 0)
        while True:
            at = self.merged.get((left, right))
            # A merge over the boundary wins if it has the lower rank; at equal rank the leftmost
            # goes first: the boundary lies right of what consumed `left`, left of what consumed `right`.
            if at is not None and (at, 1) < until:
                return False
            a = rank.get(left, -1)
            b = rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Undo the later one; of two equal merges the right one came later.
            if a > b:
                until = (a, 0)
                left = parts[left][1]
            else:
                until = (b, 2)
                right = parts[right][0]

    def _next_shorter(self, token: str) -> str | None:
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.id), None)
        return self.shorter[token]

    def word(self, symbols: str) -> list[int]:
        """Ids of one word (its byte symbols, without the end mark)."""
        if not symbols:
            return []
        text = symbols + self.end
        size = len(text)
        search, pairs, compatible = self.trie.iter_long, self.pairs, self.compatible
        dead = bytearray(size + 1)
        if self.end:
            dead[size - 1] = 1  # the end mark is no symbol of its own
        taken: list[str] = []
        at, before = 0, ""
        token = next(search(text))[1]
        while True:
            # The longest entry that starts here, or the next shorter one that fits.
            while token is not None:
                if not dead[at + len(token)]:
                    if not before:
                        break
                    fits = pairs.get((before, token))
                    if fits if fits is not None else compatible(before, token):
                        break
                token = self._next_shorter(token)
            if token is not None:
                taken.append(token)
                at += len(token)
                if at >= size:
                    break
                before = token
                token = next(search(text, at))[1]
            elif taken:
                dead[at] = 1
                token = taken.pop()
                at -= len(token)
                before = taken[-1] if taken else ""
                token = self._next_shorter(token)
            else:
                raise ValueError(f"no tokens cover {symbols[:40]!r}")
        return [self.id[t] for t in taken]


class Codec:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        whole = json.loads(file)
        model = whole["model"]
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-pair vocabularies are supported")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        own = Tokenizer.from_str(file)
        self.normalise = own.normalizer.normalize_str if own.normalizer else (lambda s: s)
        self.split = own.pre_tokenizer.pre_tokenize_str
        specials = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.special = specials
        longest_first = sorted(map(regex.escape, specials), key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(longest_first) + ")") if specials else None
        self.heads = tuple({t[0] for t in specials if t})
        strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in specials.items()}
        self.kind = np.uint16 if max(strings) < 65_536 else np.uint32
        names = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        # The decoder table: every token string and the blank that joins it to the next.
        self.buffer = np.frombuffer(b"".join(n + b" " for n in names), np.uint8)
        self.offsets = np.cumsum([0] + [len(n) + 1 for n in names])
        self.decimals = np.array([b"%d " % i for i in range(len(names))])
        pieces = [p.get("pattern", {}).get("Regex") for p in (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        steps = [n["type"] for n in (whole.get("normalizer") or {}).get("normalizers", [])]
        self.restated = pieces[:1] == [PLAIN_SPLIT] and steps == ["NFC", "Replace", "Lowercase"]
        byte_symbol = {s[0]: t for s, t in ((c, self.split(c)[0][0]) for c in "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß")} if self.restated else {}
        self.symbols = str.maketrans(byte_symbol)
        self.words = Memory(lambda word: np.array(self.merges.word(word), self.kind).tobytes())
        self.chunks = Memory(self.pack)

    def forget(self) -> None:
        """Drops the memories' old generations, which would otherwise outlive the task in a reused worker."""
        self.words.old, self.chunks.old = {}, {}

    def pack(self, text: str) -> bytes:
        """Packed ids of a text, word by word."""
        out = []
        for k, part in enumerate(self.specials.split(text) if any(c in text for c in self.heads) else [text]):
            if k % 2:
                out.append(self.kind(self.special[part]).tobytes())
            elif not part:
                continue
            elif self.restated and PLAIN.fullmatch(part):
                low = part.lower()
                if low.isalpha():
                    out.append(self.words[low if low.isascii() else low.translate(self.symbols)])
                    continue
                out += map(self.words.__getitem__, PLAIN_WORDS.findall(low) if low.isascii() else [w.translate(self.symbols) for w in PLAIN_WORDS.findall(low)])
            else:
                out += [self.words[w] for w, _ in self.split(self.normalise(part))]
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return np.empty(0, self.kind)
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, parts)), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """The token strings joined by one blank, as UTF-8."""
        pieces = []
        for at in range(0, len(ids), 65_536):  # bounds the index arrays of very long texts
            some = ids[at : at + 65_536].astype(np.int64)
            start, size = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            shift = np.repeat(start - (np.cumsum(size) - size), size)
            pieces.append(self.buffer[np.arange(len(shift)) + shift].tobytes())
        return b"".join(pieces)[:-1]

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimals, joined by one blank."""
        return self.decimals[ids].tobytes().translate(None, b"\0")[:-1]


class Memory(dict):
    """Packed ids by string, made when a string is first met.

    Two generations of ``KEEP`` entries: when the young one is full it becomes the
    old one, and what is still in use is taken over from there.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
            if len(key) > KEEP_CHARS:
                return ids
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


_CODECS: dict[str, Codec] = {}


def codec(file: str) -> Codec:
    """The codec of a tokenizer file, built once a Python worker."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(file)
    return _CODECS[key]


def _shared_file(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:  # a file beside the driver; a few MB, sent to the executors as it is
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and (``with_ids``) ``ids`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    file = _shared_file(spark, tokenizer)
    kept = docs.select(*keep, docs[text].alias("__text"))
    schema = docs.select(*keep).schema
    for name, kind in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *([("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_file = codec(file.value)
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            texts = batch.column(len(keep))
            step = 512  # rows that leave together, so that long texts don't pile up
            for at in range(0, len(texts), step):
                counts, hashes, decoded, arrays = [], [], [], []
                for t in texts.slice(at, step).to_pylist():
                    ids = with_file.encode(t)
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(with_file.decimal(ids)).hexdigest())
                    decoded.append(hashlib.sha256(with_file.decode(ids)).hexdigest())
                    arrays.append(ids)
                out = [c.slice(at, step) for c in columns] + [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    flat = np.concatenate(arrays).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
        with_file.forget()
        release()

    return kept.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the decoded ``text`` of an id column; null ids decode to the empty string."""
    spark = encoded.sparkSession
    ship(spark)
    file = _shared_file(spark, tokenizer)
    schema = encoded.select(*keep).schema.add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_file = codec(file.value)
        for batch in batches:
            texts = [with_file.decode(np.array(x or [], np.int64)).decode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*keep, ids).mapInArrow(run, schema)
