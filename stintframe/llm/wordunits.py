"""Texts cut at spaces into units, with each different unit of a slice held once.

Splitting and finding the different units run in Arrow; what is costly per unit (a tokenizer, an automaton, a lattice)
then runs once per different unit of a slice, and numpy carries the results back to every occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The code points that count as white space in Unicode or in Python.
_SPACES = {*map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])}
_CUT = re.compile(r"(?<=\S) ")


class Units(NamedTuple):
    """``codes[offsets[i]:offsets[i + 1]]`` index ``dictionary`` for text i; ``first`` marks a text's first unit."""

    codes: np.ndarray
    offsets: np.ndarray
    dictionary: pa.Array
    first: np.ndarray

    @property
    def unique(self) -> list[str]:
        return self.dictionary.to_pylist()


def split(texts: pa.Array, every_space: bool) -> Units:
    """Units of each text; a null text counts as empty.

    ``every_space``: cut at each space, dropping it (a run of spaces leaves empty units).  Otherwise cut only at spaces
    that follow something other than white space, so that joining with single spaces gives the text back either way
    and no run of white space is cut.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, " ")
    units = _coded(lists)
    if every_space:
        return units
    doubt = np.fromiter((not x or x[-1] in _SPACES for x in units.unique), bool, len(units.dictionary))[units.codes]
    odd = np.add.reduceat(np.r_[doubt, False], units.offsets[:-1]) > 0
    if not odd.any():
        return units
    again = pa.array([_CUT.split(x) for x in texts.filter(pa.array(odd)).to_pylist()], lists.type)
    order = np.empty(len(odd), np.int64)
    order[~odd] = np.arange((~odd).sum())
    order[odd] = np.arange(odd.sum()) + (~odd).sum()
    return _coded(pa.concat_arrays([lists.filter(pa.array(~odd)), again]).take(pa.array(order)))


def _coded(lists: pa.Array) -> Units:
    offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    first = np.zeros(len(coded), bool)
    first[offsets[:-1]] = True  # a text has one unit at least, if an empty one
    return Units(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary, first)


def spread(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions into a flat array for the runs that ``codes`` name one after another, and the length of each run."""
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return at + np.repeat(starts[codes] - (ends - n), n), n


class Memory:
    """Columns of numbers for units, worked out once per unit and remembered in Arrow up to ``most`` bytes.

    The first units met are remembered, among them all frequent ones.  ``work_out`` gives the columns of a list of units.
    """

    def __init__(self, work_out: Callable[[list[str]], tuple[np.ndarray, ...]], most: int = 24 << 20):
        self.work_out, self.most = work_out, most
        self.units, self.columns = pa.array([], pa.large_string()), None

    def look_up(self, units: pa.Array) -> tuple[np.ndarray, ...]:
        at = pc.index_in(units, value_set=self.units)
        unknown = pc.is_null(at)
        new = units.filter(unknown)
        found = self.work_out(new.to_pylist())
        if self.columns is None:
            self.columns = tuple(x[:0] for x in found)
        at, unknown = at.fill_null(0).to_numpy(zero_copy_only=False), unknown.to_numpy(zero_copy_only=False)
        out = tuple(np.zeros(len(units), x.dtype) for x in found)
        for column, known, fresh in zip(out, self.columns, found, strict=True):
            column[~unknown] = known[at[~unknown]]
            column[unknown] = fresh
        if len(new) and self.units.nbytes + sum(x.nbytes for x in self.columns) < self.most:
            self.units = pa.concat_arrays([self.units, new])
            self.columns = tuple(np.concatenate(x) for x in zip(self.columns, found, strict=True))
        return out
