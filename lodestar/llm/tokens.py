"""Token ids of whole texts by the tokenizers library, with repeated words encoded once."""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress

import numpy as np

#: Two neighbouring white-space characters, or the start of an added token's name: such a text goes to the library itself. (RE2)
IRREGULAR = r"[\s\x0b\x1c-\x1f\x{85}\pZ][\s\x0b\x1c-\x1f\x{85}\pZ]|<\|"
#: Beyond ASCII something else than a letter: such a text is cut at spaces only. (RE2)
COARSE = r"[^\x00-\x7f\pL]"
MARK = "\x01"
SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Lower-case letters to U+00FF in UTF-8: no normalizer changes them, and they are one word.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Characters encoded as one text, distinct units looked up at once, and bytes that an entry's objects take beside its letters and ids.
JOINED, LONG, BLOCK, ENTRY = 1 << 18, 1 << 18, 1 << 15, 170

# classes of bytes: 0 space, 1 letter (and all beyond ASCII), 2 digit, 3 sign, 4 line end, 5 the rest, apostrophes too
CLASS = np.full(256, 5, np.uint8)
CLASS[32], CLASS[10] = 0, 4
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 1
CLASS[48:58] = 2
CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'_"]] = 3
#: Class before and class behind (6 * before + behind) between which the library always cuts; a space goes with what follows it.
CUT = np.zeros(256, bool)
CUT[:36] = [b == 0 or (0 < a < 5 and 0 < b < 5 and a != b) for a in range(6) for b in range(6)]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
CLASS_TABLE, CUT_TABLE, FOLD_TABLE = CLASS.tobytes(), CUT.tobytes(), FOLD.tobytes()


class PieceEncoder:
    """Ids of texts as unsigned 32-bit numbers.

    Both vocabularies cut a text before they merge: never across a single space (it is taken
    together with what is behind it, or dropped), and always between letters, digits, signs and line ends.
    So a text is the sum of its units. A batch's units are numbered once, and each unit's ids
    are remembered. New units are encoded together, in texts of JOINED characters. Texts with runs of white
    space go through the library in stretches of LONG characters that end before a single space.
    Where tokens tell the end of a word, units of LETTERS go to the library's model past the normalizer
    and the cutting, which would leave them as they are.

    What is remembered is held in two generations of `limit_bytes` / 2 (by an estimate that counts the
    objects): when the younger is full it becomes the older one, whose units come back when they are met.
    """

    def __init__(self, path: str, keeps_space: bool, limit_bytes: int = 80 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keeps_space, self.limit = Tokenizer.from_file(path), keeps_space, limit_bytes // 2
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.weight = 0
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.short = None
        if suffix and not keeps_space:
            self.ends = np.zeros(len(self.begins), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            self.short = Tokenizer(self.tokenizer.model)
            self.short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stretches(self, text: str) -> bytes:
        """Ids of any text, encoded in stretches cut at single spaces."""
        out, at = [], 0
        while len(text) - at > LONG and (found := SINGLE.search(text, at + LONG)):
            out.append(text[at : found.start()])
            at = found.start() + (not self.keeps_space)
        return b"".join(self.whole([*out, text[at:]]))

    def _together(self, units: list[str], glue: str) -> list[bytes]:
        """Ids of units from texts of many of them: each begins with a space (glue ""), is a word of LETTERS (glue " "), or glue holds MARK."""
        tokenizer = self.short if glue == " " else self.tokenizer
        out, at = [], 0
        ends = np.cumsum([len(u) + len(glue) for u in units]) if units else np.zeros(0, np.int64)
        while at < len(units):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOINED)))
            own = units[at:to]
            ids = array("I", tokenizer.encode_batch_fast([glue.join(own)], add_special_tokens=False)[0].ids)
            data, values = ids.tobytes(), np.frombuffer(ids, np.uint32)
            if glue == " ":
                stops = np.flatnonzero(self.ends[values]) + 1
                starts = np.append(0, stops)[:-1]
            elif glue:
                cuts = np.flatnonzero(values == self.mark)
                starts, stops = np.append(0, cuts + 1), np.append(cuts, len(values))
            else:
                starts = np.flatnonzero(self.begins[values])
                stops = np.append(starts[1:], len(values))
            if len(starts) == len(own):
                out += [data[a:b] for a, b in zip((starts * 4).tolist(), (stops * 4).tolist(), strict=True)]
            else:
                out += self.whole(own)
            at = to
        return out

    def _new(self, units: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new units, by unit."""
        out = {}
        if self.short:
            plain = list(map(bool, map(LETTERS.fullmatch, units)))
            own = list(compress(units, plain))
            out.update(zip(own, self._together([u.decode() for u in own], " "), strict=True))
            units = [u for u, p in zip(units, plain, strict=True) if not p]
        texts = [u.decode() for u in units]
        joined: list[int] = []
        marked: list[int] = []
        alone: list[int] = []
        for i, t in enumerate(texts):
            if not t or t[-1].isspace() or MARK in t:
                alone.append(i)
            elif self.keeps_space and t[0] == " ":
                joined.append(i)
            elif t.isalpha() or not self.keeps_space:
                marked.append(i)
            else:
                alone.append(i)
        for own, made in (
            (alone, self.whole([texts[i] for i in alone])),
            (joined, self._together([texts[i] for i in joined], "")),
            (marked, self._together([texts[i] for i in marked], MARK if self.keeps_space else f" {MARK} ")),
        ):
            out.update(zip([units[i] for i in own], made, strict=True))
        return out

    def _remember(self, learned: dict[bytes, bytes]) -> None:
        self.weight += len(learned) * ENTRY + sum(map(len, learned)) + sum(map(len, learned.values()))
        self.memo.update(learned)
        if self.weight > self.limit:
            self.memo, self.older, self.weight = {}, self.memo, 0

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, remembered or new."""
        found = list(map(self.memo.get, units))
        absent = [i for i, ids in enumerate(found) if ids is None]
        if absent:
            missing = [units[i] for i in absent]
            learned = {u: ids for u, ids in zip(missing, map(self.older.get, missing), strict=True) if ids is not None}
            learned.update(self._new([u for u in missing if u not in learned]))
            for i, u in zip(absent, missing, strict=True):
                found[i] = learned[u]
            self._remember(learned)
        return found

    def _units(self, texts) -> tuple:
        """Units of regular texts as an Arrow array over one buffer, and how many lie before each text's start and the end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4) if n else np.zeros(1, np.int32)
        own = texts.buffers()[2] if n else None
        data = own.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if own else b""
        offsets = offsets - offsets[0]
        kind = np.frombuffer(data.translate(CLASS_TABLE), np.uint8)
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = np.frombuffer((kind[:-1] * np.uint8(6) + kind[1:]).tobytes().translate(CUT_TABLE), bool)
        coarse = np.flatnonzero(pc.match_substring_regex(texts, COARSE).to_numpy(zero_copy_only=False)) if n else []
        for i in coarse:
            cut[offsets[i] : offsets[i + 1]] = kind[offsets[i] : offsets[i + 1]] == 0
        cut[offsets] = True
        at = np.flatnonzero(cut).astype(np.int32)
        before = np.searchsorted(at, offsets)
        if not self.keeps_space:  # this vocabulary is lower case, and drops the space that a unit may begin with
            data = data.translate(FOLD_TABLE, b" ")
            at[1:] -= np.cumsum(kind[at[:-1]] == 0, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), before

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts end to end, and where each text begins (one more for the end)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = np.flatnonzero(pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)).tolist()
        regular = texts
        if odd:
            plain = texts.to_pylist()
            for i in odd:
                plain[i] = ""
            regular = pa.array(plain, pa.string())
        units, before = self._units(regular)
        flat = units.dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [ids for at in range(0, len(distinct), BLOCK) for ids in self._ids(distinct[at : at + BLOCK])]
        taken = pa.array(found, pa.large_binary()).take(flat.indices)
        _, ends, own = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(taken) + 1) >> 2 if len(taken) else np.zeros(1, np.int64)
        ids = np.frombuffer(own, "<u4", int(ends[-1])) if ends[-1] else np.zeros(0, "<u4")
        starts = ends[before]
        if not odd:
            return ids, starts
        pieces = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for i, text in zip(odd, texts.take(pa.array(odd)).to_pylist(), strict=True):
            pieces[i] = np.frombuffer(self.stretches(text), "<u4")
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """The encoder of this worker, with what it remembers from earlier tasks."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keeps_space)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps `name`."""
    import public_tokenizers

    return public_tokenizers.path(name)
