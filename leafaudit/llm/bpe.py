"""BPE encoding, decoding and token counts by batched merge rounds.

The symbols of many words lie in one flat array. Each round looks all adjacent pairs up
by binary search over the sorted pair keys, finds the lowest rank of each word, merges
that pair wherever the word has it, left to right, and closes the gaps. Words without a
known pair leave the array. A merge always has a higher rank than those that made its
parts (checked when a vocabulary is read), so merging all places of the lowest pair at
once gives what a queue of single merges gives.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafaudit.llm.common import each_batch, text_or_empty

SPACE = r"\p{White_Space}"
#: The split patterns that the two kinds of vocabulary files are made for.
BYTE_LEVEL_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!\S)|{SPACE}+"
CACHE_WORDS = 700_000
CACHES: dict[tuple[str, str], dict] = {}
#: Marks of parts, lone surrogates that no text holds: a first part, a single word, a special string.
FIRST, WORD, SPECIAL = "\ud800", "\ud801", "\udfff"
#: White space of str.split() that the patterns don't know; white space but single blanks; white space beside a blank.
CONTROLS = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(rf"{SPACE}{{2,}}|(?! ){SPACE}")
MIXED_SPACE = re.compile(r" \s|\s ")
LONG_WORD = 4096
NO_RANK = np.iinfo(np.int64).max
#: Stands between parts in an array of ids; no id is as large.
BETWEEN = b"\xff\xff\xff\xff"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """A BPE file as flat arrays; small enough to travel with a task (about 50,000 entries)."""

    tokens: list[str]
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    special: dict[str, int]
    suffix: str
    normalized: bool
    word_pattern: str
    digest: str

    @staticmethod
    def read(path: str) -> Vocabulary:
        """Read a tokenizers file with a BPE model over bytes."""
        with open(path, "rb") as f:
            raw = f.read()
        spec = json.loads(raw)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        product = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        made = np.full(len(tokens), -1, dtype=np.int64)
        made[product] = rank
        if len(np.unique(product)) != len(product) or (np.maximum(made[left], made[right]) >= rank).any():
            raise ValueError("merges are not in the order in which their parts are made")
        keys = (left << 32) | right
        order = np.argsort(keys)
        alphabet = byte_alphabet()
        pre = json.dumps(spec["pre_tokenizer"])
        pattern = BYTE_LEVEL_WORDS
        if spec["pre_tokenizer"]["type"] == "Sequence":
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        if "ByteLevel" not in pre:
            raise ValueError("not a byte-level vocabulary")
        return Vocabulary(
            tokens=tokens,
            first=np.array([ids.get(c, -1) for c in alphabet], dtype=np.int64),
            last=np.array([ids.get(c + suffix, -1) for c in alphabet], dtype=np.int64),
            keys=keys[order], ranks=rank[order], products=product[order],
            special=special, suffix=suffix, normalized=spec.get("normalizer") is not None, word_pattern=pattern,
            digest=hashlib.sha256(raw).hexdigest(),
        )

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def cache(self, kind: str) -> dict:
        """A table that later tasks of the same worker find again."""
        return CACHES.setdefault((self.digest, kind), {})

    @cached_property
    def token_bytes(self) -> list[bytes]:
        return [t.encode() for t in self.tokens]

    @cached_property
    def words_of(self):
        return regex.compile(self.word_pattern).findall

    @cached_property
    def split_special(self):
        return regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True)))

    @cached_property
    def words_and_blanks(self):
        return regex.compile(f"{self.word_pattern}| ").findall

    def normalize(self, text: str) -> str:
        """NFC, white space to one blank, lower case letter by letter (a final sigma too)."""
        if not self.normalized:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return SPACES.sub(" ", text).lower()

    def keys_of(self, text: str) -> list[str]:
        """The parts of a text that are encoded independently of one another, in order.

        Words never span white space, so the usual parts are what stands between blanks
        (in a byte-level file the blank before a part belongs to it; the first has none).
        Texts with special strings or odd white space are cut into single words."""
        if any(s in text for s in self.special):
            out: list[str] = []
            at = 0
            for m in self.split_special.finditer(text):
                out += [WORD + w for w in self.words_of(self.normalize(text[at : m.start()]))]
                out.append(SPECIAL + m[0])
                at = m.end()
            return out + [WORD + w for w in self.words_of(self.normalize(text[at:]))]
        if self.normalized:
            return text.split() if not CONTROLS.search(text) else [WORD + w for w in self.words_of(self.normalize(text))]
        if not text:
            return []
        if text[0].isspace() or text[-1] == " " or MIXED_SPACE.search(text):
            return [WORD + w for w in self.words_of(text)]
        keys = text.split(" ")
        keys[0] = FIRST + keys[0]
        return keys

    def words_in(self, key: str) -> list[str]:
        """Words of a part that keys_of gave."""
        mark = key[:1]
        if mark == WORD:
            return [key[1:]]
        if self.normalized:
            return self.words_of(self.normalize(key))
        return self.words_of(key[1:] if mark == FIRST else " " + key)

    def merge(self, words: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each word."""
        symbols, ends = self.merge_flat(words)
        return np.split(symbols, ends[:-1]) if len(words) else []

    @cached_property
    def made(self) -> np.ndarray:
        """The symbol that the merge of each rank makes."""
        return self.products[np.argsort(self.ranks)]

    def pair_ranks(self, symbols: np.ndarray, word: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Rank of the pair of the symbol at each place and the next of its word, or NO_RANK."""
        after = np.minimum(places + 1, len(symbols) - 1)
        key = (symbols[places] << 32) | symbols[after]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (word[places] == word[after]) & (after > places)
        return np.where(known, self.ranks[at], NO_RANK)

    def merge_flat(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's end."""
        done_symbols, done_words = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(b) for b in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.first[flat]
        word = np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size)[size > 0] - 1
        symbols[ends] = self.last[flat[ends]]
        rank = self.pair_ranks(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.r_[starts, len(word)])
            done = least == NO_RANK
            keep = ~np.repeat(done, spans)
            if done.any():
                done_symbols.append(symbols[~keep])
                done_words.append(word[~keep])
                if done.all():
                    break
            places = np.flatnonzero(keep & (rank == np.repeat(least, spans)))
            # of a run of overlapping places (a pair of equal symbols) every second one merges
            run = np.flatnonzero(np.r_[True, np.diff(places) != 1])
            step = np.arange(len(places)) - np.repeat(run, np.diff(np.r_[run, len(places)]))
            equal = symbols[places] == symbols[places + 1]
            places = places[~equal | (step % 2 == 0)]
            symbols[places] = self.made[rank[places]]
            keep[places + 1] = False
            changed = (np.cumsum(keep) - 1)[places]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # only pairs with a merged symbol have a new rank
            changed = np.concatenate([changed, changed[changed > 0] - 1])
            rank[changed] = self.pair_ranks(symbols, word, changed)
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbols)[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def merge_all(self, words: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, list[int]]]:
        """Batches of distinct words with their ids in one array and where each word's end;
        very long words come alone."""
        words = list(words)
        short = [w for w in words if len(w) <= LONG_WORD]
        parts = [short[at : at + 20_000] for at in range(0, len(short), 20_000)] + [[w] for w in words if len(w) > LONG_WORD]
        for part in parts:
            symbols, ends = self.merge_flat(part)
            yield part, symbols, ends.tolist()

    def encode_keys(self, keys: set[str]) -> dict[str, tuple[bytes, bytes, int]]:
        """For each part its ids as bytes, its tokens joined by blanks, and its count; kept
        between batches in tables of bounded size."""
        cache, known = self.cache("parts"), self.cache("words")
        new = [k for k in keys if k not in cache]
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(keys)
        words = {k: self.words_in(k) for k in new if k[:1] != SPECIAL}
        every = set().union(*words.values())
        missing = every - known.keys()
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = every
        tokens = self.token_bytes
        for part, symbols, ends in self.merge_all(missing):
            raw, ids, at = symbols.astype("<u4").tobytes(), symbols.tolist(), 0
            for w, end in zip(part, ends, strict=True):
                known[w] = (raw[4 * at : 4 * end], b" ".join([tokens[i] for i in ids[at:end]]), end - at)
                at = end
        for k in new:
            if k[:1] == SPECIAL:
                i = self.special[k[1:]]
                cache[k] = (np.array([i], "<u4").tobytes(), tokens[i], 1)
            elif len(words[k]) == 1:
                cache[k] = known[words[k][0]]
            else:
                parts = [known[w] for w in words[k]]
                cache[k] = (b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]), sum([p[2] for p in parts]))
        return cache

    def encode_ids(self, keys: set[str]) -> dict[str, bytes]:
        """For each part its ids as bytes, without the decoded text."""
        cache, known = self.cache("part ids"), self.cache("word ids")
        new = [k for k in keys if k not in cache]
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(keys)
        # plain parts hold no white space, so blanks between them part their words too
        plain = [k for k in new if self.normalized and k[:1] not in (WORD, SPECIAL)]
        found = self.words_and_blanks(self.normalize(" ".join(plain)))
        words = {k: self.words_in(k) for k in new if k[:1] == WORD or not self.normalized and k[:1] != SPECIAL}
        every = {*found} - {" "} | {*chain.from_iterable(words.values())}
        missing = every - known.keys()
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = every
        for part, symbols, ends in self.merge_all(missing):
            raw = symbols.astype("<u4").tobytes()
            known.update((w, raw[4 * at : 4 * end]) for w, at, end in zip(part, [0, *ends], ends, strict=False))
        get = known.__getitem__
        if plain:
            known[" "] = BETWEEN
            raw = b"".join(map(get, found))
            del known[" "]
            cuts = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == 0xFFFFFFFF)).tolist()
            cache.update((k, raw[at:end]) for k, at, end in zip(plain, [0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True))
        cache.update((k, b"".join(map(get, ws))) for k, ws in words.items())
        cache.update((k, np.array([self.special[k[1:]]], "<u4").tobytes()) for k in new if k[:1] == SPECIAL)
        return cache

    def decode(self, ids: Iterable[int]) -> str:
        """Vocabulary strings joined by one blank, as a file without a decoder asks for."""
        return " ".join([self.tokens[i] for i in ids])

    def encode(self, text: str | None) -> np.ndarray:
        keys = self.keys_of(text or "")
        table = self.encode_keys(set(keys))
        return np.frombuffer(b"".join([table[k][0] for k in keys]), dtype="<u4")


def encode_documents(docs: DataFrame, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns (doc_id, ids, decoded) per row, in the row's own task. A null text counts as
    empty and gives no ids and an empty string; repeated rows each give a row; a null id
    stays null; other columns are ignored."""
    vocabulary = Vocabulary.read(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 512):
            words = [vocabulary.keys_of(t) for t in batch.column(1).to_pylist()]
            table = vocabulary.encode_keys(set().union(*words))
            ids = [np.frombuffer(b"".join([table[w][0] for w in ws]), dtype="<u4") for ws in words]
            decoded = [b" ".join(filter(None, [table[w][1] for w in ws])).decode() for ws in words]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_documents, with digests in place of the ids and the decoded text:
    (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    vocabulary = Vocabulary.read(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 512):
            words = [vocabulary.keys_of(t) for t in batch.column(1).to_pylist()]
            table = vocabulary.encode_keys(set().union(*words))
            count, ids_sha, text_sha = [], [], []
            for ws in words:
                entries = [table[w] for w in ws]
                count.append(sum([e[2] for e in entries]))
                ids_sha.append(hashlib.sha256(b"".join([e[0] for e in entries])).hexdigest())
                text_sha.append(hashlib.sha256(b" ".join(filter(None, [e[1] for e in entries]))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def whole_tokens(vocabulary: Vocabulary) -> frozenset[str]:
    """The strings of the vocabulary that encode alone as one token, found by merging each."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    found: list[str] = []
    for token in vocabulary.tokens:
        if token and token not in vocabulary.special and all(c in back for c in token):
            try:
                found.append(bytes([back[c] for c in token]).decode())
            except UnicodeDecodeError:
                continue
    return frozenset(w for w, ids in zip(found, vocabulary.merge(found), strict=True) if len(ids) == 1)


def token_counts(docs: DataFrame, vocabulary_path: str, *, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text, with the words that are one token counted by a table
    look-up and only the others merged.

    Returns (doc_id, n_bytes, n_tokens, over_limit) per row. A null text counts as empty
    (0 bytes, 0 tokens); repeated rows each give a row; other columns are ignored. The
    table of whole tokens is proved once on the driver; its size is the vocabulary's."""
    vocabulary = Vocabulary.read(vocabulary_path)
    if vocabulary.normalized or vocabulary.suffix:
        raise ValueError("the shortcut needs a vocabulary whose words are plain substrings")
    whole = whole_tokens(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = vocabulary.cache("counts")
        for batch in each_batch(batches, 512):
            keys = [vocabulary.keys_of(t) for t in batch.column(1).to_pylist()]
            every = set().union(*keys)
            new = [k for k in every if k not in known]
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(every)
            rest: dict[str, list[str]] = {}
            for k in new:
                words = vocabulary.words_in(k) if k[:1] != SPECIAL else []
                more = [w for w in words if w not in whole]
                known[k] = max(len(words), k[:1] == SPECIAL) - len(more)
                if more:
                    rest[k] = more
            merged: dict[str, int] = {}
            for part, _, ends in vocabulary.merge_all(set().union(*rest.values())):
                merged.update(zip(part, np.diff([0, *ends]).tolist(), strict=True))
            for k, more in rest.items():
                known[k] += sum([merged[w] for w in more])
            counts = [sum(map(known.__getitem__, ks)) for ks in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    body = text_or_empty(text)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    counted = picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
