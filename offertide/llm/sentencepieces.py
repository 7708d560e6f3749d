"""SentencePiece encoding and decoding in vectorised merge rounds.

A text is escaped (one blank mark put before it, blanks written as the mark) and cut into
words where no piece of the vocabulary holds the two characters side by side, so no merge can
cross a cut. The words of a batch that are not remembered yet lie in one flat numpy array of
symbols. Each round finds the best pair rank of every word by a segmented minimum, merges
all its leftmost, non-overlapping occurrences at once, and closes the gaps; words without a
pair leave the array, and rounds go on until none is left.

Merging all occurrences at once equals the one-by-one order only if no pair that the new
symbol forms ranks as good as the pair itself. Ranks where this may happen are known from
the vocabulary; in such rounds a word merges its leftmost occurrence only. Words with more
than MANY such occurrences, as very long runs of blanks have, and words unfinished after ROUNDS
rounds go on from where they are with a heap, in the same order.

Null and empty texts have no ids, and null or empty id lists decode to the empty text. Ids
outside the vocabulary decode to nothing, control pieces too. Rows are encoded one by
one, so repeated rows, null keys and empty tables need no care; other columns are carried
along, one that bears the name of the result is replaced. Texts are never cut short; the memory of a
task grows with its longest text.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from offertide.llm.common import slices

ROUNDS = 96
MANY = 256
BATCH_CHARS = 1 << 20
"""Characters encoded, or bytes decoded, at a time; a longer text is a batch of its own."""
KEPT_WORDS = 400_000
KEPT_LENGTH = 48
"""Words of at most so many characters are remembered by a Python worker, about 60 MB of them."""

BLANK = "▁"  # fixed value: the mark that stands for a blank
UNKNOWN = " ⁇ "  # fixed value: how the unknown piece is written
_NONE = np.int32(np.iinfo(np.int32).max)
_CHARS = 0x110000


class PieceModel:
    """Tables of a byte-pair SentencePiece model with identity normalisation and byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        pieces = [library.id_to_piece(k) for k in range(size)]
        special = {k for k in range(size) if library.is_control(k) or library.is_unknown(k) or library.is_byte(k)}
        ids = {p: k for k, p in enumerate(pieces) if k not in special}
        self.size = size
        self.byte_ids = np.full(256, -1, np.int32)
        for k in range(size):
            if library.is_byte(k):
                self.byte_ids[int(pieces[k][3:5], 16)] = k
        scores = np.array([library.get_score(k) for k in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # 0 is the best score

        self.char_ids = -1 - np.arange(_CHARS, dtype=np.int32)  # characters without a piece stay negative
        for p, k in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = k
        self._merges(ids, rank)
        self._cuts(ids)
        self._surfaces(pieces, special, library)
        self.known: dict[str, bytes] = {}
        probes = ["", " ", "  a  b ", "ＡÅ Å Ω", "x\ny\tz", "café \U0001f600́", BLANK + " q"]
        if any(library.encode(t) != self.encode([t])[0].tolist() for t in probes):
            raise ValueError("not a byte-pair model with identity normalisation, leading blank and byte fallback")

    def _merges(self, ids: dict[str, int], rank: np.ndarray) -> None:
        """Sorted keys of pairs, what they merge into, and ranks whose merges must go one by one."""
        keys, merged = [], []
        by_rank = np.bincount(rank[list(ids.values())], minlength=int(rank.max()) + 2)
        self.single = by_rank > 1  # several pieces share the rank
        for p, k in ids.items():
            for j in range(1, len(p)):
                a, b = ids.get(p[:j]), ids.get(p[j:])
                if a is None or b is None:
                    continue
                keys.append(a * self.size + b)
                merged.append(k)
                for part in (a, b):
                    if rank[k] <= rank[part]:
                        self.single[rank[part]] = True
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array([*np.array(keys, np.int64)[order], np.iinfo(np.int64).max])
        self.merged = np.array([*np.array(merged, np.int32)[order], 0], np.int32)
        self.ranks = np.array([*rank[self.merged[:-1]], _NONE], np.int32)
        self.pairs: dict[int, tuple[int, int]] | None = None

    def _cuts(self, ids: dict[str, int]) -> None:
        """Which characters stand side by side in some piece."""
        letters = sorted({c for p in ids if len(p) > 1 for c in p})
        self.letter = np.zeros(_CHARS, np.uint16)
        self.letter[[ord(c) for c in letters]] = 1 + np.arange(len(letters))
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in ids:
            for a, b in itertools.pairwise(p):
                self.beside[self.letter[ord(a)], self.letter[ord(b)]] = True
        # Words begin at blanks if blanks only begin pieces; line ends stand alone if in none.
        line = "" if self.letter[10] else "\n"
        blank_ends = self.beside[1:, self.letter[ord(BLANK)]].nonzero()[0] + 1
        only_first = set(blank_ends) <= {self.letter[ord(BLANK)]}
        self.words = re.compile(f"{BLANK}*[^{BLANK}{line}]+|{BLANK}+" + (f"|{line}+" if line else "") if only_first else r"(?s:.+)")

    def _surfaces(self, pieces: list[str], special: set[int], library) -> None:
        """Bytes that each id stands for, flat; the last entry stands for ids outside the vocabulary."""
        out = [b"" if k in special else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        for value, k in enumerate(self.byte_ids):
            if k >= 0:
                out[k] = bytes([value])
        for k in range(self.size):
            if library.is_unknown(k):
                out[k] = UNKNOWN.encode()
        out.append(b"")
        self.surface = np.frombuffer(b"".join(out), np.uint8)
        self.surface_size = np.array([len(s) for s in out], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.is_byte = np.zeros(self.size + 1, bool)
        self.is_byte[self.byte_ids[self.byte_ids >= 0]] = True
        self.leads = np.array([k not in special and p.startswith(BLANK) for k, p in enumerate(pieces)] + [False])
        self.silent = np.array([library.is_control(k) for k in range(self.size)] + [True])

    # Encoding

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.words.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:  # the words met first are the common ones
            self.known = dict(itertools.islice(self.known.items(), KEPT_WORDS // 4))
        new = list(set(itertools.chain.from_iterable(cut)).difference(self.known))
        fresh = dict(zip(new, self._encode_words(new), strict=True)) if new else {}
        long = {w: ids for w, ids in fresh.items() if len(w) > KEPT_LENGTH}
        self.known.update((w, ids) for w, ids in fresh.items() if len(w) <= KEPT_LENGTH)
        find = (lambda w: long[w] if w in long else self.known[w]) if long else self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, words)), np.int32) for words in cut]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes; words are handled in batches, and cut further by their letters."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            end, chars = at, 0
            while end < len(words) and (end == at or chars + len(words[end]) <= BATCH_CHARS):
                chars += len(words[end])
                end += 1
            sizes = np.array([len(w) for w in words[at:end]])
            codes = np.frombuffer("".join(words[at:end]).encode("utf-32-le"), np.uint32)
            first = np.zeros(len(codes), bool)
            first[np.cumsum(sizes) - sizes] = True
            letter = self.letter[codes]
            cut = first.copy()
            cut[1:] |= ~self.beside[letter[:-1], letter[1:]]
            part = np.cumsum(cut) - 1
            owner = (np.cumsum(first) - 1)[cut]  # word of each part
            symbols, parts = self.merge(self.char_ids[codes], part)
            ids, counts = self._with_bytes(symbols)
            ends = np.cumsum(np.bincount(owner[parts], counts, len(sizes))).astype(np.int64) * 4
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]
            at = end
        return out

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and the word of each, for flat symbols whose words are numbered in order."""
        done_symbols, done_words, aside = [], [], []
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            ends = np.r_[word[1:] != word[:-1], True]
            left, right = symbols[:-1].astype(np.int64), symbols[1:]
            key = np.where((left >= 0) & (right >= 0) & ~ends[:-1], left * self.size + right, -1)
            at = np.searchsorted(self.keys, key)
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.r_[True, ends[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(least, sizes)
            ended = best == _NONE
            done_symbols.append(symbols[ended])
            done_words.append(word[ended])
            found = np.flatnonzero((rank == best) & ~ended)
            if not len(found):
                symbols = symbols[:0]
                break
            # In a run of overlapping occurrences the leftmost wins, so every second one merges.
            new_run = np.r_[True, np.diff(found) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(found)), 0))
            taken = (np.arange(len(found)) - run_start) % 2 == 0
            one_by_one = self.single[rank[found]]
            if one_by_one.any():
                first_of_word = np.r_[True, np.diff(word[found]) != 0]
                taken &= ~one_by_one | first_of_word
                slow = np.bincount(word[found] - word[0], one_by_one) > MANY
                if slow.any():
                    own = np.append(slow, False)[np.minimum(word - word[0], len(slow))]
                    aside.append((symbols[own], word[own]))
                    ended |= own
                    taken &= ~own[found]
            found = found[taken]
            symbols = symbols.copy()
            symbols[found] = self.merged[at[found]]
            kept = ~ended
            kept[found + 1] = False
            symbols, word = symbols[kept], word[kept]
        for left, owner in [*aside, (symbols, word)]:
            for own in np.split(np.arange(len(left)), np.flatnonzero(np.diff(owner)) + 1) if len(left) else []:
                ids = self._by_heap(left[own])
                done_symbols.append(ids)
                done_words.append(np.full(len(ids), owner[own[0]], owner.dtype))
        symbols = np.concatenate([*done_symbols, np.zeros(0, np.int32)])
        word = np.concatenate([*done_words, np.zeros(0, word.dtype)])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _by_heap(self, symbols: np.ndarray) -> np.ndarray:
        """Merges of one word one by one, best rank first and then leftmost."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys[:-1].tolist(), zip(self.ranks[:-1].tolist(), self.merged[:-1].tolist(), strict=True), strict=True))
        pairs, size, n = self.pairs, self.size, len(symbols)
        now, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int, j: int) -> tuple[int, int] | None:
            return pairs.get(now[i] * size + now[j]) if now[i] >= 0 and now[j] >= 0 else None

        heap = [p[0] << 40 | i for i in range(n - 1) if (p := pair(i, i + 1))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & (1 << 40) - 1
            j = after[i]
            if now[i] is None or j >= n:
                continue
            p = pair(i, j)
            if p is None or p[0] != top >> 40:
                continue
            now[i], now[j] = p[1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if p := pair(i, after[i]):
                    heapq.heappush(heap, p[0] << 40 | i)
            if before[i] >= 0 and (p := pair(before[i], i)):
                heapq.heappush(heap, p[0] << 40 | before[i])
        return np.array([s for s in now if s is not None], np.int32)

    def _with_bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, characters without a piece as their UTF-8 bytes, and the number of ids of each symbol."""
        odd = np.flatnonzero(symbols < 0)
        counts = np.ones(len(symbols), np.int64)
        if not len(odd):
            return symbols, counts
        raw = [chr(-1 - s).encode() for s in symbols[odd].tolist()]
        counts[odd] = [len(r) for r in raw]
        ids = np.repeat(symbols, counts)
        ids[np.repeat(symbols < 0, counts)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, counts

    # Decoding

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 bytes of all texts and the size of each, for flat ids and their number by text."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        text = np.repeat(np.arange(len(sizes)), sizes)
        size, at = self.surface_size[ids], self.surface_at[ids]
        # The first piece that is not a control piece loses the blank put before the text.
        said = np.flatnonzero(~self.silent[ids])
        first = said[np.r_[True, np.diff(text[said]) != 0]] if len(said) else said
        first = first[self.leads[ids[first]]]
        size[first] -= 1
        at[first] += 1
        ahead = np.cumsum(size) - size
        raw = self.surface[np.repeat(at - ahead, size) + np.arange(int(size.sum()))]
        lengths = np.bincount(text, size, len(sizes)).astype(np.int64)
        odd = np.flatnonzero(np.bincount(text[self.is_byte[ids]], minlength=len(sizes)))
        if len(odd) == 0:
            return raw.tobytes(), lengths
        ends, rows = np.cumsum(lengths), np.cumsum(sizes)
        out, last = [], 0
        for t in odd.tolist():
            start, end = int(ends[t] - lengths[t]), int(ends[t])
            own, mine = raw[start:end].tobytes(), slice(int(rows[t] - sizes[t]), int(rows[t]))
            try:
                broken = self.silent[ids[mine]].any()  # they end a run of byte pieces
                own.decode()
            except UnicodeDecodeError:
                broken = True
            if broken:
                own = self._mended(ids[mine], at[mine], size[mine])
            out += [raw[last:start].tobytes(), own]
            lengths[t], last = len(own), end
        return b"".join([*out, raw[last:].tobytes()]), lengths

    def _mended(self, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> bytes:
        """Bytes of one text in which runs of byte pieces need not be UTF-8: a bad byte becomes U+FFFD."""
        out = []
        for is_byte, run in itertools.groupby(range(len(ids)), lambda k: bool(self.is_byte[ids[k]])):
            own = b"".join(self.surface[at[k]:at[k] + size[k]].tobytes() for k in run)
            if not is_byte:
                out.append(own)
                continue
            k = 0
            while k < len(own):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(own[k:k + n].decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�".encode())
                k += n
        return b"".join(out)


def _model(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def _mapped(df: DataFrame, column: str, keep: Sequence[str] | None, out: T.StructField, work) -> DataFrame:
    """The kept columns of `df` and one more, which `work` makes from `column` batch by batch."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out.name]
    schema = T.StructType([*[df.schema[c] for c in kept], out])
    # Columns travel under names of their own, so any may be dropped, kept or replaced.
    source = df.select(*[df[c].alias(f"_{k}") for k, c in enumerate(kept)], df[column].alias("_input"))

    def run(batches):
        for batch in batches:
            for rows, made in work(batch.column(len(kept)), batch):
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in range(len(kept))], made], names=[*kept, out.name])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, model: str | None = None, text_col: str = "text", ids_col: str = "ids",
           keep: Sequence[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) plus the ids of each text, without begin or end ids."""
    path = _model(model)

    def work(texts, batch):
        own = _loaded(path)
        texts = texts.to_pylist()
        for a, b in slices([len(t or "") for t in texts], BATCH_CHARS):
            ids = own.encode(texts[a:b])
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield batch.slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))

    return _mapped(df, text_col, keep, T.StructField(ids_col, T.ArrayType(T.IntegerType())), work)


def decode(df: DataFrame, model: str | None = None, ids_col: str = "ids", text_col: str = "decoded",
           keep: Sequence[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) plus the text of each list of ids."""
    path = _model(model)

    def work(lists, batch):
        own = _loaded(path)
        sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
        for a, b in slices((4 * sizes).tolist(), BATCH_CHARS):
            flat = lists.slice(a, b - a).drop_null().flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            raw, lengths = own.decode(flat.astype(np.int64), sizes[a:b])
            offsets = np.cumsum([0, *lengths.tolist()], dtype=np.int32)
            yield batch.slice(a, b - a), pa.StringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(raw))

    return _mapped(df, ids_col, keep, T.StructField(text_col, T.StringType()), work)


_LOADED: dict[str, PieceModel] = {}


def _loaded(path: str) -> PieceModel:
    """The model, read once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]
