"""Token ids of whole texts with the tokenizers library, encoding each different unit once.

For the two kinds of BPE file below, units cut at spaces are independent of each other, so a unit is encoded once and its
ids are reused wherever it occurs.  Units that are new to a worker are pre-tokenized here, joined, and passed to the
library's BPE model in one call.  Any other tokenizer file, and any unit with characters beyond Latin or with the text of
a special token, goes through the library's own full encoding, so results are those of ``Tokenizer.encode`` throughout.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .wordunits import split, spread

#: Bytes of units and their ids that a worker remembers: the first it meets, among them all frequent ones; others are encoded
#: where they occur.
REMEMBERED = 32 << 20
_PLAIN = regex.compile(r"[\u0000\u0002-\u024f]*")
# The split patterns of the two kinds of file.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as is, the rest from U+0100 on."""
    table, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            table[b] = chr(b)
        else:
            table[b] = chr(extra)
            extra += 1
    return table


class TokenIds:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.settings = {False: (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer), True: (normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit())}
        self.bare = False
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, after = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        model = spec["model"]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.kind = "other"
        plain_model = model["type"] == "BPE" and not model.get("dropout") and not spec.get("post_processor")
        if plain_model and before is None and after.get("type") == "ByteLevel" and after["use_regex"] and not after["add_prefix_space"]:
            self.kind, self.pattern, self.tail = "byte", regex.compile(_BYTE_LEVEL), 0
        elif (
            plain_model
            and before
            and [x["type"] for x in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in after.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and after["pretokenizers"][0]["pattern"]["Regex"] == _WORD_LEVEL
        ):
            self.kind, self.pattern, self.tail = "word", regex.compile(_WORD_LEVEL), len(model.get("end_of_word_suffix") or "")
        if self.kind != "other":
            size = max(model["vocab"].values()) + 1
            self.id_chars = np.zeros(size, np.int64)
            for piece, i in model["vocab"].items():
                self.id_chars[i] = len(piece)
            self.letters = np.array([ord(x) for x in byte_letters().values()], np.uint32)
        self.units = pa.array([], pa.large_string())
        self.pool, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str], bare: bool = False) -> list:
        """The library's encodings; ``bare`` without normalisation and cutting at spaces only."""
        if self.bare != bare:
            normalizer, self.tokenizer.pre_tokenizer = self.settings[bare]
            if self.settings[False][0] is not None:
                self.tokenizer.normalizer = normalizer
            self.bare = bare
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.special)

    def _learn(self, units: list[str]) -> list[str]:
        """Encode units and append their ids to the pool; the units in the order of their ids.  A unit stands as it is in the
        text, with the space before it at byte level."""
        odd: list[str] = []
        found = []
        for k in range(0, len(units), 4096):
            some = units[k : k + 4096]
            # a byte-level unit without its leading space begins a text: there are few, and the library takes them whole
            apart = [x for x in some if x[:1] != " "] if self.kind == "byte" else []
            if apart:
                some = [x for x in some if x[:1] == " "]
            if not self._plain("".join(some)):
                apart += [x for x in some if not self._plain(x)]
                some = [x for x in some if self._plain(x)]
            odd += apart
            if some:
                ids, stops = (self._byte_level if self.kind == "byte" else self._word_level)(some)
                found.append((some, ids, stops))
        if odd:
            full = [e.ids for e in self._library(odd)]
            found.append((odd, np.array([i for x in full for i in x], np.uint32), np.cumsum([len(x) for x in full])))
        for _, ids, stops in found:
            starts = np.r_[0, stops[:-1]].astype(np.int64)
            self.starts, self.lengths = np.r_[self.starts, starts + len(self.pool)], np.r_[self.lengths, stops - starts]
            self.pool = np.r_[self.pool, ids]
        return [x for some, _, _ in found for x in some]

    def _bpe(self, words: str, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words joined by spaces in byte letters, and the number of ids up to each of the given counts of letters."""
        ids = np.array(self._library([words], bare=True)[0].ids, np.uint32)
        reach = np.r_[0, np.cumsum(self.id_chars[ids])]
        stops = np.searchsorted(reach, chars)
        if (reach[stops] != chars).any() or stops[-1] != len(ids):
            raise ValueError("the BPE model's pieces do not cover its words")
        return ids, stops

    def _byte_level(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(units)
        raw = text.encode()
        letters = self.letters[np.frombuffer(raw, np.uint8)]
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        reach = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]  # bytes before each character
        pieces = self.pattern.findall(text)
        breaks = reach[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))][:-1]
        words = np.insert(letters, breaks, 32).astype("<u4").tobytes().decode("utf-32-le")
        return self._bpe(words, reach[np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])

    def _word_level(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = " \x01 ".join(units) + " \x01"
        pieces = self.pattern.findall(text.lower() if text.isascii() else self.settings[False][0].normalize_str(text))
        marks = np.fromiter((x == "\x01" for x in pieces), bool, len(pieces))
        words = [x for x in pieces if x != "\x01"]
        joined = " ".join(words)
        sizes = np.fromiter(map(len, words) if joined.isascii() else (len(x.encode()) for x in words), np.int64, len(words))
        raw = np.frombuffer(joined.encode(), np.uint8)
        mapped = np.where(raw == 32, 32, self.letters[raw]).astype("<u4").tobytes().decode("utf-32-le")
        reach = np.r_[0, np.cumsum(sizes + self.tail)]
        return self._bpe(mapped, reach[np.cumsum(~marks)[marks]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one flat array of uint32, and the offsets of each text in it; a null text has none."""
        if self.kind == "other":
            found = [np.array(e.ids, np.uint32) for e in self._library([x or "" for x in texts.to_pylist()])]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
        units = split(texts, every_space=self.kind == "word")
        codes, names = units.codes, units.dictionary
        if self.kind == "byte":  # a unit after the first begins with the space before it
            codes = codes + np.where(units.first, len(names), 0)
            names = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type)), names])
            used = np.flatnonzero(np.bincount(codes, minlength=len(names)))
            place = np.zeros(len(names), np.int64)
            place[used] = np.arange(len(used))
            names, codes = names.take(pa.array(used)), place[codes]
        before = len(self.starts), len(self.pool)
        at = pc.index_in(names, value_set=self.units)
        unknown = pc.is_null(at)
        new = names.filter(unknown)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            order = self._learn(new.to_pylist())
            number = dict(zip(order, range(before[0], before[0] + len(order)), strict=True))
            at[unknown.to_numpy(zero_copy_only=False)] = np.fromiter(map(number.__getitem__, new.to_pylist()), np.int64, len(new))
        at, n = spread(at[codes], self.starts, self.lengths)
        ids = self.pool[at]
        if len(new):
            if self.units.nbytes + self.pool.nbytes + 2 * self.starts.nbytes < REMEMBERED:
                self.units = pa.concat_arrays([self.units, pa.array(order, pa.large_string())])
            else:
                self.starts, self.lengths, self.pool = self.starts[: before[0]], self.lengths[: before[0]], self.pool[: before[1]]
        return ids, np.r_[0, np.cumsum(n)][units.offsets].astype(np.int64)


@cache
def token_ids(path: str) -> TokenIds:
    """One encoder per worker process and file."""
    return TokenIds(path)
