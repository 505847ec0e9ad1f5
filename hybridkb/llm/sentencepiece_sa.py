"""SentencePiece (BPE model) encoding and decoding by suffix-array matching.

A batch's texts are cut into units that no piece crosses (a run of spaces with the word behind it; a newline
or a NUL). A unit's occurrences share one entry, so the batch text that is indexed is the concatenation of its
different new units (cut further at marks that no piece joins to a letter):

1. the units' characters lie one after the other, and their suffixes are sorted to the length of the longest
   piece, by words of as many characters as 62 bits hold;
2. every piece is binary-searched for its range of occurrences, all pieces at once;
3. the occurrences become edges, sorted by the place where they end;
4. the edges are relaxed in that order, all units in step. BPE has one result for each prefix of a unit: the
   edge that ends there and whose piece is compatible with the last piece of the prefix before it. Two pieces
   are compatible if merging the characters of both gives just these two. So there is one last piece for each
   place, and the path is read backwards.

Characters that are no piece become their UTF-8 bytes (byte fallback). The result is the same as the
library's. Null and empty texts have no tokens. U+2581 in a text is a space, as in the library. Repeated rows
get equal tokens, empty tables stay empty, very long texts are encoded whole; other columns stay as they are,
but an own column named ``ids`` is replaced by ``encode_documents``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hybridkb.llm.common import WORKER_CACHES, give_back, list_column, mix64, field_hash, slices_by_bytes, field_span, text_buffers

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SLAB = 1 << 20
ADD_CHARS = 120_000  # characters of units that are indexed at a time
CACHED_UNITS = 120_000  # kept between batches by a worker; a bound on memory only
PAIR_BITS = 19  # places of the table of compatible pairs; a bound on memory only
SPACE_MARK = "\u2581"
MARKS = ".,;:!?%*#$&|"
LETTER = r"[^\W\d_¹²³]"
NONE, START = -1, -2


COMPARED = 1 << 16  # bytes of units that are compared at once


class Vocabulary:
    """Pieces, merge ranks and byte pieces of a model; small, and sent to the workers whole."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_of: list[int]):
        self.pieces, self.byte_of = pieces, byte_of
        self.rank = {p: (-s, i) for i, (p, s, n) in enumerate(zip(pieces, scores, normal, strict=True)) if n}
        self.byte_id = {b: i for i, b in enumerate(byte_of) if b >= 0}
        # Marks that no piece has behind a letter end a unit there.
        cut = [c for c in MARKS if not any(re.search(LETTER + re.escape(c), p) for p in self.rank)]
        word = f"{SPACE_MARK}*{LETTER}++(?=[{re.escape(''.join(cut))}])|" if cut else ""
        self.part = re.compile(f"{word}{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")
        self.digest = hashlib.sha256(repr((pieces, scores, normal, byte_of)).encode("utf-8", "surrogatepass")).hexdigest()

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in ids]
        byte_of = [int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else -1 for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [not x for x in special], byte_of)


def merge(rank: dict[str, tuple[float, int]], text: str) -> list[str]:
    """Plain BPE of a short string: the best adjacent pair first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best = min(((rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def edge_states(rank: dict[str, tuple[float, int]], piece: str) -> tuple[list, list, bool]:
    """While ``piece`` is merged alone: the symbols at its left and right edge, each with the ranks of the
    merges that make and end it; and whether the merges come in rising order of rank."""
    parts, rising, before = list(piece), True, -np.inf
    left, right = [[parts[0], -np.inf, np.inf]], [[parts[-1], -np.inf, np.inf]]
    while len(parts) > 1:
        r, i = min((rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank)
        rising, before = rising and r >= before, r
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        for states, changed in ((left, i == 0), (right, i == len(parts) - 1)):
            if changed:
                states[-1][2] = r
                states.append([parts[0] if states is left else parts[-1], r, np.inf])
    return left, right, rising


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        rank = vocabulary.rank
        good = [p for p in rank if merge(rank, p) == [p]]  # pieces that merging can reach
        self.ids = np.array([rank[p][1] for p in good], dtype=np.int64)
        self.lengths = np.array([len(p) for p in good], dtype=np.int64)
        self.depth = int(self.lengths.max())
        chars = np.zeros((len(good), self.depth), dtype=np.uint32)
        for i, p in enumerate(good):
            chars[i, : len(p)] = [ord(c) for c in p]
        self.alphabet, back = np.unique(chars, return_inverse=True)
        self.chars = back.reshape(chars.shape)
        self.pair_code = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.states: dict[int, tuple[list, list, bool]] = {}
        self.index: dict[bytes, int] = {}
        self.begin, self.size, self.blob = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the units that more than one batch has used."""
        keep = self.used > 1
        place = np.cumsum(keep) - 1
        self.index = {u: int(place[i]) for u, i in self.index.items() if keep[i]}
        begin, size = self.begin[keep], self.size[keep]
        self.blob = self.blob[_ranges(begin, size)]
        self.size, self.used = size, np.zeros(len(size), np.int32)
        self.begin = np.cumsum(size) - size

    def _suffixes(self, code: np.ndarray, left: np.ndarray, bits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array of the units (code 0 ends a unit, left counts the characters before it), sorted to
        ``depth`` characters, and the word of the first ``per`` characters at each place."""
        n = len(code)
        word = np.zeros(n, dtype=np.int64)
        for j in range(per):
            word <<= bits
            if j < n:
                word[: n - j] |= np.where(left[: n - j] > j, code[j:], 0)
        order = np.argsort(word)
        first = word[order]
        group = np.concatenate(([0], np.cumsum(first[1:] != first[:-1])))
        at = np.arange(n)
        for level in range(1, -(-self.depth // per)):
            # What is tied and goes on is sorted by its next word.
            tied = np.zeros(len(at), dtype=bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            tied &= left[order[at]] > level * per
            at, group = at[tied], group[tied]
            if not len(at):
                break
            rows = order[at]
            following = word[rows + level * per]
            by = np.lexsort((following, group))
            order[at] = rows[by]
            following, group = following[by], group[by]
            group = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | (following[1:] != following[:-1]))))
        return order, word

    def _occurrences(self, code: np.ndarray, known: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, start) of all pieces in the indexed text."""
        bits = int(len(known)).bit_length()
        per = 62 // bits
        suffixes, word = self._suffixes(code, left, bits, per)
        first = word[suffixes]
        here = np.minimum(np.searchsorted(known, self.alphabet), len(known) - 1)
        codes = np.where(known[here] == self.alphabet, here, -1)
        codes[self.alphabet == 0] = 0
        codes = codes[self.chars]
        piece = np.flatnonzero((codes >= 0).all(axis=1))
        codes = codes[piece]
        lo, hi = np.zeros(len(piece), np.int64), np.full(len(piece), len(suffixes), np.int64)
        found = []
        for level in range(-(-self.depth // per)):
            part = codes[:, level * per : (level + 1) * per]
            least = np.zeros(len(piece), dtype=np.int64)
            for j in range(per):
                least = (least << bits) | (part[:, j] if j < part.shape[1] else 0)
            rest = np.clip(per - (self.lengths[piece] - level * per), 0, per) * bits
            most = least + (np.int64(1) << rest) - 1
            if level == 0:
                lo, hi = np.searchsorted(first, least, side="left"), np.searchsorted(first, most, side="right")
            else:
                lo, hi = (self._bisect(lo, hi, suffixes, word, left, level * per, bound, upper) for bound, upper in ((least, False), (most, True)))
            over = self.lengths[piece] <= (level + 1) * per
            some = lo < hi
            found.append((piece[over & some], lo[over & some], hi[over & some]))
            going = some & ~over
            piece, codes, lo, hi = piece[going], codes[going], lo[going], hi[going]
            if not len(piece):
                break
        piece, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.repeat(piece, hi - lo), suffixes[_ranges(lo, hi - lo)]

    @staticmethod
    def _bisect(lo, hi, suffixes, word, left, skip: int, bound: np.ndarray, upper: bool) -> np.ndarray:
        """In each range of suffixes, the first whose word behind ``skip`` characters reaches (passes, if upper) the bound."""
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = suffixes[np.minimum(mid, len(suffixes) - 1)]
            seen = np.where(left[at] > skip, word[np.minimum(at + skip, len(word) - 1)], 0)
            right = open_ & ((seen <= bound) if upper else (seen < bound))
            a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
        return a

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces gives just the two: whether no merge across their
        border is ever the next one. Of equal ranks the left one goes first."""
        rank, pieces = self.v.rank, self.v.pieces
        for x in (a, b):
            if x not in self.states:
                self.states[x] = edge_states(rank, pieces[x])
        (_, right, rising_a), (left, _, rising_b) = self.states[a], self.states[b]
        if not (rising_a and rising_b):
            return merge(rank, pieces[a] + pieces[b]) == [pieces[a], pieces[b]]
        for x, made_a, end_a in right:
            for y, made_b, end_b in left:
                cross = rank.get(x + y)
                if cross is not None and made_a <= end_b and made_b < end_a and cross[0] < end_a and cross[0] <= end_b:
                    return False
        return True

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces (by id) can stand side by side; START always. Verdicts are kept in a table that newer
        pairs overwrite."""
        size = len(self.v.pieces)
        code = left * size + right
        slot = (mix64(code.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_fits[slot]
        ask = np.flatnonzero((self.pair_code[slot] != code) & (left >= 0))
        if len(ask):
            pairs, at, back = np.unique(code[ask], return_index=True, return_inverse=True)
            fits = np.array([self._side_by_side(pair // size, pair % size) for pair in pairs.tolist()], dtype=bool)
            ok[ask] = fits[back]
            self.pair_code[slot[ask[at]]], self.pair_fits[slot[ask[at]]] = pairs, fits
        ok[left == START] = True
        return ok

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens of each part), some 100,000s of characters at a time."""
        tokens, sizes, size, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0, 0
        for i, u in enumerate(parts):
            size += len(u) + 1
            if size >= ADD_CHARS or i == len(parts) - 1:
                t, n = self._index_and_relax(parts[at : i + 1])
                tokens.append(t)
                sizes.append(n)
                size, at = 0, i + 1
        return np.concatenate(tokens), np.concatenate(sizes)

    def _index_and_relax(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        unit_first = np.repeat(first, sizes + 1)
        left = np.repeat(first + sizes, sizes + 1) - np.arange(len(text))
        # A unit may be a NUL itself, so ends are told by place and not by value.
        codes = np.where(left > 0, text.astype(np.int64) + 1, 0)
        known = np.unique(codes)
        piece, start = self._occurrences(np.searchsorted(known, codes), np.maximum(known - 1, 0).astype(np.uint32), left)
        token = self.ids[piece]
        stop = start + self.lengths[piece]
        # Characters without a piece: one edge of their own, which separates what stands beside it.
        lone = left > 0
        lone[start[stop - start == 1]] = False
        lone = np.flatnonzero(lone)
        start, stop, token = np.concatenate([start, lone]), np.concatenate([stop, lone + 1]), np.concatenate([token, np.full(len(lone), START)])
        place = stop - unit_first[start]
        order = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
        start, stop, token, place = start[order], stop[order], token[order], place[order]
        last = np.full(len(text) + 1, NONE, dtype=np.int64)  # the last piece of the prefix that ends here
        came = np.zeros(len(text) + 1, dtype=np.int64)
        last[first] = START
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, e, t = start[a:b], stop[a:b], token[a:b]
            before = last[s]
            ok = before != NONE
            asked = np.flatnonzero(ok & (t >= 0))
            ok[asked] = self._allowed(before[asked], t[asked])
            s, e, t = s[ok], e[ok], t[ok]
            last[e], came[e] = t, s
        # Backwards, all units in step.
        at = first + sizes
        steps = []
        live = np.flatnonzero(sizes > 0)
        while len(live):
            e = at[live]
            steps.append((live, last[e], came[e]))
            at[live] = came[e]
            live = live[at[live] > first[live]]
        u, t, s = (np.concatenate(x) for x in zip(*steps, strict=True))
        turn = np.repeat(np.arange(len(steps), 0, -1), [len(x[0]) for x in steps])
        order = np.argsort(u * (len(steps) + 1) + turn)
        u, t, s = u[order], t[order], s[order]
        alone = np.flatnonzero(t == START)
        coded = [[self.v.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in text[s[alone]].tolist()]
        n = np.ones(len(t), dtype=np.int64)
        n[alone] = [len(x) for x in coded]
        tokens = np.repeat(t, n).astype(np.int32)
        if len(alone):
            tokens[np.repeat(t, n) == START] = np.concatenate(coded)
        return tokens, np.bincount(u, weights=n, minlength=len(units)).astype(np.int64)

    def _add(self, units: list[bytes]) -> None:
        """Encode units that are not known yet."""
        alone = [i for i, u in enumerate(units) if u in (b"\n", b"\0")]
        words = [u for u in units if u not in (b"\n", b"\0")]
        # One line for each unit; the line ends tell which parts are whose.
        parts = self.v.part.findall((b"\n".join(words) + b"\n").decode("utf-8", "surrogatepass").replace(" ", SPACE_MARK)) if words else []
        number = dict.fromkeys(parts) | dict.fromkeys(["\n", "\0"])
        number = dict(zip(number, range(len(number)), strict=True))
        which = np.array(list(map(number.__getitem__, parts)), dtype=np.int64)
        line = which == number["\n"]
        per = np.diff(np.flatnonzero(line), prepend=-1) - 1
        which = which[~line]
        for i in alone:  # a newline or NUL is its own part
            at = int(per[:i].sum())
            per, which = np.insert(per, i, 1), np.insert(which, at, number[units[i].decode()])
        tokens, n = self._encode_parts(list(number))
        begin = np.cumsum(n) - n
        own = np.concatenate(([0], np.cumsum(n[which])))[np.concatenate(([0], np.cumsum(per)))]
        base = len(self.size)
        self.begin = np.concatenate([self.begin, len(self.blob) + own[:-1]])
        self.size = np.concatenate([self.size, np.diff(own)])
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int32)])
        self.blob = np.concatenate([self.blob, tokens[_ranges(begin[which], n[which])]])
        self.index.update(zip(units, range(base, base + len(units)), strict=True))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        data, offs = text_buffers(texts)
        filled = np.diff(offs) > 0
        # Every text that is not empty gets a space in front.
        data = np.insert(data, offs[:-1][filled], 0x20)
        offs = offs + np.concatenate(([0], np.cumsum(filled)))
        mark = SPACE_MARK.encode()
        raw = data.tobytes()
        if mark in raw:
            cut = offs.tolist()
            pieces = [raw[a:b].replace(mark, b" ") for a, b in zip(cut[:-1], cut[1:], strict=True)]
            raw = b"".join(pieces)
            data, offs = np.frombuffer(raw, dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        start = _unit_starts(data, offs)
        stop = np.concatenate((start[1:], [len(data)])) if len(start) else start
        number = self._numbers(raw, data, start, stop)
        n = self.size[number]
        tokens = self.blob[_ranges(self.begin[number], n)]
        ends = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, offs)]
        return list_column(tokens, np.diff(ends), pa.int32())

    @staticmethod
    def _differing(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """The units whose bytes are not those of the unit ``lead`` that stands for them."""
        length = stop - start
        wrong = length != length[lead]
        unit = np.flatnonzero(~wrong & (lead != np.arange(len(lead))))
        total = np.concatenate(([0], np.cumsum(length[unit])))
        x = 0
        while x < len(unit):
            y = max(x + 1, int(np.searchsorted(total, total[x] + COMPARED, side="right")) - 1)
            here = unit[x:y]
            row = np.repeat(np.arange(y - x), length[here])
            place = np.arange(len(row)) - np.repeat(total[x:y] - total[x], length[here])
            differ = data[start[here][row] + place] != data[start[lead[here]][row] + place]
            wrong[here[row[differ]]] = True
            x = y
        return np.flatnonzero(wrong)

    def _numbers(self, raw: bytes, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The entry of each unit data[start:stop]. Units are gathered by their hash, compared by all their bytes, and
        one of each kind is looked up."""
        if not len(start):
            return start
        key = field_span(field_hash(data), start, stop)
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        odd = self._differing(data, start, stop, at[back])
        if len(odd):  # units that share a hash, but not their bytes, stand for themselves
            back[odd] = len(at) + np.arange(len(odd))
            at = np.concatenate([at, odd])
        units = [raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
        if len(self.index) + len(units) > CACHED_UNITS:
            self._forget()
        get = self.index.get
        entry = np.array([get(u, -1) for u in units], dtype=np.int64)
        new = np.flatnonzero(entry < 0)
        if len(new):
            base = len(self.size)
            self._add([units[i] for i in new.tolist()])
            entry[new] = np.arange(base, base + len(new))
        self.used[entry] += 1
        return entry[back]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, and so on."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def _unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where units begin: at a text's start, at the first of a run of spaces, at and behind a newline or NUL."""
    space, alone = data == 0x20, (data == 0x0A) | (data == 0)
    begins = alone.copy()
    begins[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
    begins[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(begins)


_encoders: dict[str, Encoder] = {}
WORKER_CACHES.append(_encoders)


def _worker_encoder(digest: str, shared) -> Encoder:
    """A worker's encoder of the vocabulary with this digest, kept between tasks; one at a time."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(shared.value)
    return _encoders[digest]


def encode_column(documents: DataFrame, text: str = "text", model_file: str = MODEL_FILE) -> Column:
    """The token ids of a text column, as array<int>. They go back slab by slab, as the ids of a whole batch
    would stand in memory twice here and once more in the JVM."""
    vocabulary = Vocabulary.load(model_file)
    digest, shared = vocabulary.digest, documents.sparkSession.sparkContext.broadcast(vocabulary)

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _worker_encoder(digest, shared)
        for texts in batches:
            for at, n in slices_by_bytes(texts, SLAB):
                yield encoder.encode(texts.slice(at, n))
                give_back()

    return encode(F.col(text).cast("string"))


def decode_column(documents: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> Column:
    """The text of an array<int> column of token ids; ids outside the vocabulary and control pieces give nothing."""
    v = Vocabulary.load(model_file)
    raw = [bytes([b]) if b >= 0 else (p.replace(SPACE_MARK, " ").encode() if p in v.rank else b"") for p, b in zip(v.pieces, v.byte_of, strict=True)] + [b""]
    shared = documents.sparkSession.sparkContext.broadcast(raw)

    @arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        raw = shared.value
        size = np.array([len(x) for x in raw], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        blob = np.frombuffer(b"".join(raw), dtype=np.uint8)
        out: list[str | None] = []
        for x in lists:
            if not x.is_valid:
                out.append(None)
                continue
            ids = x.values.to_numpy(zero_copy_only=False)
            ids = np.where((ids >= 0) & (ids < len(raw) - 1), ids, len(raw) - 1).astype(np.int64)
            n = size[ids]
            total = np.concatenate(([0], np.cumsum(n)))
            data = blob[np.repeat(begin[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
            out.append(data.decode("utf-8", "replace").removeprefix(" "))
        return pa.array(out, type=pa.string())

    return decode(F.col(ids))


def encode_documents(documents: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """The documents with their columns and ``ids``; an own column of that name is replaced."""
    return documents.withColumn("ids", encode_column(documents, "text", model_file))
