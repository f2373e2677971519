"""BPE encoding by an index of pair occurrences, and decoding."""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts whose words are merged together: an index holds the pairs of this many bytes of a partition at most, or of one text.
INDEX_BYTES = 2 << 20
_CODECS: dict[str, Codec] = {}


class PairIndex:
    """All words of a part as one row of symbols, with the positions of each mergeable pair.

    A pair is known by its merge rank. The lowest active rank is applied to all its positions from
    left to right; each merge unlinks a symbol and enters the two pairs it makes in their lists, so
    ranks become active as their pairs appear. Positions whose pair a neighbour has used are passed
    over. Where a merge makes a pair of a lower rank, the rest of that word waits for it, as merging
    the word alone would.
    """

    def __init__(self, words: Iterable[list[int]], rules: dict[int, tuple[int, int]], shift: int):
        words = list(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = np.fromiter(itertools.chain.from_iterable(words), dtype=np.int64, count=int(sizes.sum()))
        self.rules, self.shift, self.count = rules, shift, len(words)
        self.word = np.repeat(np.arange(len(words)), sizes)
        inside = self.word[1:] == self.word[:-1]
        at = np.arange(len(symbols))
        self.after = np.append(np.where(inside, at[1:], -1), [-1] * (len(at) > 0)).astype(np.int64).tolist()
        self.before = np.append([-1] * (len(at) > 0), np.where(inside, at[:-1], -1)).astype(np.int64).tolist()
        self.symbols = symbols.tolist()
        self.positions: dict[int, list[int]] = {}
        pairs = (symbols[:-1] << shift) | symbols[1:]
        places = np.flatnonzero(inside)
        order = places[np.argsort(pairs[places], kind="stable")]
        keys, starts = np.unique(pairs[order], return_index=True)
        for key, found in zip(keys.tolist(), np.split(order, starts[1:]) if len(keys) else [], strict=True):
            if key in rules:
                self.positions[key] = found.tolist()
        self.active = [(rules[key][0], key) for key in self.positions]
        heapq.heapify(self.active)

    def merge(self) -> list[bytes]:
        """The ids of each word (little-endian, 32 bits) when no pair can be merged."""
        symbols, after, before, positions, active = self.symbols, self.after, self.before, self.positions, self.active
        shift, mask, rule_of = self.shift, (1 << self.shift) - 1, self.rules.get
        while active:
            rank, key = heapq.heappop(active)
            left, right, made = key >> shift, key & mask, self.rules[key][1]
            waiting, held = set(), []
            for at in sorted(positions.pop(key)):
                following = after[at]
                if symbols[at] != left or following < 0 or symbols[following] != right:
                    continue
                if waiting and self.word[at] in waiting:
                    held.append(at)
                    continue
                symbols[at], symbols[following] = made, -1
                beyond, previous = after[following], before[at]
                after[at] = beyond
                pairs = []
                if beyond >= 0:
                    before[beyond] = at
                    pairs.append((at, (made << shift) | symbols[beyond]))
                if previous >= 0:
                    pairs.append((previous, (symbols[previous] << shift) | made))
                for place, pair in pairs:
                    rule = rule_of(pair)
                    if rule is None:
                        continue
                    if pair in positions:
                        positions[pair].append(place)
                    else:
                        positions[pair] = [place]
                        heapq.heappush(active, (rule[0], pair))
                    if rule[0] < rank:
                        waiting.add(self.word[at])
            if held:
                positions[key] = held + positions.get(key, [])
                heapq.heappush(active, (rank, key))
        left = np.array(symbols, dtype=np.int64)
        alive = left >= 0
        ids = left[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(self.word[alive], minlength=self.count))).tolist()
        return [ids[a:b] for a, b in itertools.pairwise([0, *ends])]


class Codec:
    """A BPE vocabulary file: its normalisation and pattern, its merges by ``PairIndex``.

    Words are found by ``tokenizers`` itself, white-space-separated string by string. Where a string
    has only characters that no normalisation changes but for their case, and whose classes have
    always been the same (``PLAIN``), the file's pattern gives the same words by ``regex``, faster.
    Words are remembered once merged, up to a number of short ones.
    """

    MOST, LONGEST = 300_000, 64
    PLAIN = re.compile("[\\t-\\r -~\\u00a1-\\u024f\\u2010-\\u2027\\u20ac]*")
    SPACE = re.compile("[\\t-\\r ]+")
    #: The steps of a file whose normalisation leaves plain characters as they are.
    STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        self.tokenizer, model = Tokenizer.from_file(path), read["model"]
        self.normalize, self.pattern = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        normal, split = read["normalizer"].get("normalizers", []), read["pre_tokenizer"].get("pretokenizers", [])
        self.find = None
        if ([x["type"] for x in normal], [x["type"] for x in split]) == self.STEPS and split[0]["behavior"] == "Removed" and split[0]["invert"]:
            self.find = regex.compile(split[0]["pattern"]["Regex"]).findall
        added = self.tokenizer.get_added_tokens_decoder()
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.shift = max([*ids.values(), *added, 1]).bit_length()
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rules = {(ids[a] << self.shift) | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        # the vocabulary spells printable bytes as themselves, and the others, in order, by the characters from 256
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        spelt = [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]
        self.inner, self.last = [ids[s] for s in spelt], [ids[s + suffix] for s in spelt]
        self.special = {t.content: i for i, t in added.items()}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.known: dict[str | int, bytes] = {}

    def _words(self, text: str) -> list[str]:
        """The words of a text without added tokens, normalised."""
        if self.find and self.PLAIN.fullmatch(text):
            return self.find(text.lower())
        words: list[str] = []
        for chunk in self.SPACE.split(text):
            if self.find and self.PLAIN.fullmatch(chunk):
                words += self.find(chunk.lower())
            else:
                normal = self.normalize(chunk)
                words += [normal[a:b] for _, (a, b) in self.pattern(normal)]
        return words

    def units(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of added tokens named in it."""
        units: list[str | int] = []
        at = 0
        for found in self.specials.finditer(text):
            units += [*self._words(text[at : found.start()]), self.special[found.group()]]
            at = found.end()
        return units + self._words(text[at:]) if at else self._words(text)

    def _symbols(self, word: str) -> list[int]:
        spelt = word.encode("utf-8")
        return [*map(self.inner.__getitem__, spelt[:-1]), self.last[spelt[-1]]]

    def learn(self, units: Iterable[str | int]) -> None:
        """Remember the ids (little-endian, 32 bits) of units, all words merged by one index."""
        words = [u for u in units if isinstance(u, str)]
        self.known.update(zip(words, PairIndex(map(self._symbols, words), self.rules, self.shift).merge(), strict=True))
        self.known.update((u, u.to_bytes(4, "little")) for u in units if isinstance(u, int))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts. What no earlier part had is learned together."""
        split = [self.units(t) for t in texts]
        every = set().union(*split)
        new = every.difference(self.known)
        if len(self.known) + len(new) > self.MOST:
            self.known = {u: self.known[u] for u in every.intersection(self.known)}
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, units)) for units in split]
        for unit in new:
            if len(self.known) > self.MOST or (isinstance(unit, str) and len(unit) > self.LONGEST):
                del self.known[unit]
        return out


class Spelling:
    """How a vocabulary file spells its tokens, for decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        names = {i: s for s, i in read["model"]["vocab"].items()} | {t["id"]: t["content"] for t in read["added_tokens"]}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: their tokens' spellings with a space between; a null list has none."""
        lists = pc.fill_null(ids, pa.scalar([], ids.type))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(lists.flatten())), " ")


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def public_file() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id, ``ids`` (array of int).

    The ids are those of the ``tokenizers`` library for the vocabulary at ``path`` without special
    tokens around a text; an added token's name inside a text is that token. Null and empty texts,
    and texts of white space, have no ids. Each partition is encoded on its own, without a shuffle;
    repeated rows and rows without an id stay as they are; other columns are ignored. An empty
    table gives an empty result.
    """
    path = path or public_file()

    def make():
        held = codec(path)

        def work(part: pa.RecordBatch) -> dict:
            found = held.encode(list(common.texts_of(part)))
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])])
            flat = pa.array(np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32))
            return {"id": part.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.map_parts(rows, make, "id long, ids array<int>", INDEX_BYTES).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per input row: id, ids, ``text``: what the library decodes, special tokens kept.

    A null list of ids is taken as an empty one, whose text is empty.
    """
    path = path or public_file()

    def make():
        held = Spelling(path)
        return lambda part: {"id": part.column("id"), "ids": part.column("ids"), "text": held.decode(part.column("ids"))}

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return common.map_parts(rows, make, "id long, ids array<int>, text string", INDEX_BYTES).withColumnRenamed("id", id_col)
