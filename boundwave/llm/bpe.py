"""BPE encoding and decoding by speculation and verification.

Greedy longest-match proposes tokens for every distinct piece. A proposal is the exact BPE result if
each token is what merging makes of its own string and no merge would ever cross the border between
two neighbours. The second test depends on the pair alone: merges inside both tokens happen in rank
order, so a crossing exists iff some suffix part of the left token and some prefix part of the right
one form a merge of lower rank than the merges that use these parts up (an equal rank counts on the
right side, as the leftmost occurrence goes first). All pairs are tested as NumPy arrays; only pieces
with a failing pair are merged step by step.

Defined results: null and empty texts have no tokens; texts may be of any length; repeated rows give
repeated rows; special tokens' strings are recognised in a text as the library does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import chosen, per_slice, table, words_of

VOCABULARY = "word_bpe_49k.json"
#: Upper bounds of what one worker remembers: bytes of distinct words (with PER_WORD for the tables they are in), and pairs of neighbours.
#: With the library's own model there are no tables for merges, so more words have room.
REMEMBERED_BYTES, PER_WORD, REMEMBERED_PAIRS = {"speculate": 32 << 20, "library": 64 << 20}, 120, 1_000_000
#: Longer pieces are merged one by one, with a heap.
LONG_PIECE = 400
NEVER = np.int64(1) << 40
#: In these ranges NFC changes nothing and lower-casing is by single characters.
PLAIN = regex.compile(r"[\x21-\x7E¡-įı-ɏ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table_, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table_:
            table_[b] = chr(spare)
            spare += 1
    return [table_[b] for b in range(256)]


class Merges:
    """Tokens as trees of merges, with vectorised tests of neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.vocab = vocab
        size = max(vocab.values()) + 1
        self.size = size
        self.end = "\x00"  # stands for the suffix, so that a piece's symbols are single characters
        short = {t[: -len(suffix)] + self.end if suffix and t.endswith(suffix) else t: i for t, i in vocab.items()}
        self.ids = short
        self.longest: dict[str, int] = {}
        for t in short:
            self.longest[t[:3]] = max(self.longest.get(t[:3], 1), len(t))
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([self._product(a, b) for a, b in merges], dtype=np.int64)
        order = np.argsort(left * size + right, kind="stable")
        self.keys, self.ranks = (left * size + right)[order], order.astype(np.int64)
        self.made = made
        self._spines(left, right, made)
        self.known_keys, self.known_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.rank_of: dict[int, int] = {}

    def _product(self, a: str, b: str) -> int:
        return self.vocab[a + b]

    def _spines(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        size = self.size
        self.born = np.full(size, -1, np.int64)
        parts = np.full((size, 2), -1, np.int64)
        times = np.bincount(made, minlength=size)
        self.born[made] = np.arange(len(made))
        parts[made, 0], parts[made, 1] = left, right
        whole = times <= 1  # a token that two merges make has no tree of its own
        made_of = parts[:, 0] >= 0
        whole[made_of] &= (self.born[parts[made_of, 0]] < self.born[made_of]) & (self.born[parts[made_of, 1]] < self.born[made_of])
        self.spine = []
        for side in (1, 0):  # the left token's suffix parts, the right token's prefix parts
            nodes, used = [np.arange(size)], [np.full(size, NEVER)]
            while True:
                last = nodes[-1]
                nxt = np.where(last >= 0, parts[last, side], -1)
                if (nxt < 0).all():
                    break
                nodes.append(nxt)
                used.append(np.where(nxt >= 0, self.born[last], -1))
            self.spine.append((np.stack(nodes), np.stack(used)))
        inner = np.flatnonzero(made_of)
        fine = whole.copy()
        fine[inner] &= ~self._crosses(parts[inner, 0], parts[inner, 1], self.born[inner])
        for t in inner[np.argsort(self.born[inner])]:  # parts come before the tokens made of them
            fine[t] &= fine[parts[t, 0]] & fine[parts[t, 1]]
        self.own = fine

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NEVER)

    def _crosses(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge crosses the border of a and b; with `until` (the rank of their own merge), before that merge."""
        found = np.zeros(len(a), bool)
        (ln, lu), (rn, ru) = self.spine
        limit = np.full(len(a), NEVER) if until is None else until
        for i in range(len(ln)):
            if not (ln[i][a] >= 0).any():
                break
            for j in range(len(rn)):
                if not (rn[j][b] >= 0).any():
                    break
                if until is not None and i == j == 0:
                    continue
                rank = self._rank(ln[i][a], rn[j][b])
                found |= (rank < np.minimum(lu[i][a], limit)) & (rank <= np.minimum(ru[j][b], limit - (until is not None)))
        return found

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether both stay whole beside each other."""
        key = a * self.size + b
        new = np.setdiff1d(key, self.known_keys)
        if len(new):
            ok = ~self._crosses(new // self.size, new % self.size)
            if len(self.known_keys) + len(new) > REMEMBERED_PAIRS:
                self.known_keys, self.known_ok = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(key)
                ok = ~self._crosses(new // self.size, new % self.size)
            keys, oks = np.concatenate((self.known_keys, new)), np.concatenate((self.known_ok, ok))
            order = np.argsort(keys)
            self.known_keys, self.known_ok = keys[order], oks[order]
        return self.known_ok[np.searchsorted(self.known_keys, key)]

    def greedy(self, piece: str) -> list[int]:
        out, at, n = [], 0, len(piece)
        ids, longest = self.ids, self.longest
        while at < n:
            stop = min(n, at + longest.get(piece[at : at + 3], 2))
            while stop == n - 1 or (found := ids.get(piece[at:stop])) is None:  # the end mark stays with the last letter
                stop -= 1
                if stop <= at:
                    raise KeyError(f"no token for {piece[at]!r}")
            out.append(found)
            at = stop
        return out

    def exact(self, pieces: list[str]) -> list[list[int]]:
        """Step by step: always the merge of lowest rank, the leftmost first; all short pieces side by side, those of like length together."""
        out: list[list[int]] = [[] for _ in pieces]
        symbols = [[self.ids[c] for c in [*p[:-2], p[-2:]]] for p in pieces]
        sizes = np.fromiter(map(len, symbols), np.int64, len(symbols))
        for row in np.flatnonzero(sizes > LONG_PIECE):
            out[row] = self._merged_long(symbols[row])
        short = np.flatnonzero(sizes <= LONG_PIECE)
        order = short[np.argsort(sizes[short], kind="stable")]
        at = 0
        while at < len(order):
            wide = int(sizes[order[at]])
            stop = int(np.searchsorted(sizes[order], max(wide + 2, wide * 5 // 4), side="right"))
            stop = min(stop, at + max(1, (1 << 21) // max(1, int(sizes[order[min(stop, len(order)) - 1]]))))
            rows = order[at:stop]
            for row, ids in zip(rows, self._merged([symbols[r] for r in rows]), strict=True):
                out[row] = ids
            at = stop
        return out

    def _merged(self, symbols: list[list[int]]) -> list[list[int]]:
        wide = max(map(len, symbols)) + 1
        grid = np.full((len(symbols), wide), -1, np.int64)
        for r, x in enumerate(symbols):
            grid[r, : len(x)] = x
        rank = self._rank(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(len(grid), wide - 1)
        live, done = np.arange(len(grid)), [None] * len(symbols)
        while len(live):
            at = rank.argmin(1)
            least = rank[np.arange(len(rank)), at]
            ended = least == NEVER
            for r in np.flatnonzero(ended):
                row = grid[r]
                done[live[r]] = row[row >= 0].tolist()
            keep = np.flatnonzero(~ended)
            if not len(keep):
                break
            live, grid, rank, at, least = live[keep], grid[keep], rank[keep], at[keep], least[keep]
            r = np.arange(len(grid))
            grid[r, at] = self.made[least]
            cols = np.arange(grid.shape[1])[None, :]
            grid = np.concatenate((grid, np.full((len(grid), 1), -1, np.int64)), 1)[r[:, None], cols + (cols > at[:, None])]
            rank = np.concatenate((rank, np.full((len(rank), 1), NEVER)), 1)[r[:, None], cols[:, :-1] + (cols[:, :-1] > at[:, None])]
            rank[r, at] = self._rank(grid[r, at], grid[r, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._rank(grid[left, at[left] - 1], grid[left, at[left]])
        return done

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same for one piece, in n log n steps: a heap of (rank, place) over linked neighbours."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ranks, size, made = self.rank_of, self.size, self.made
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(symbols[i] * size + symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] * size + symbols[j]) != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = int(made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] * size + symbols[k])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] * size + symbols[i])) is not None:
                heappush(heap, (r, h))
        return [s for s in symbols if s >= 0]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each piece (its symbols, then `end`)."""
        out = [self.greedy(p) for p in pieces]
        if not out:
            return out
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        bad = np.zeros(len(out), bool)
        np.logical_or.at(bad, owner[~self.own[flat]], True)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        ok = self.fit(flat[pair], flat[pair + 1])
        bad[owner[pair[~ok]]] = True
        self.failed = int(bad.sum())
        wrong = np.flatnonzero(bad)
        for i, ids in zip(wrong, self.exact([pieces[i] for i in wrong]), strict=True):
            out[i] = ids
        return out


class WordEncoder:
    """Encodes texts word by word, each distinct word once: normalising, splitting and merging never cross ASCII white space.

    `by` is "speculate" (this module's merges) or "library" (the library's own model encodes the distinct pieces)."""

    def __init__(self, path: str, by: str = "speculate"):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.by, self.most_bytes = by, REMEMBERED_BYTES[by]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"]) if by == "speculate" else None
        names = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.numbers = pa.array([str(i) for i in range(max(names) + 1)], pa.large_string())
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held_bytes = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _pieces(self, word: str) -> list[str]:
        """A word's pieces in the vocabulary's letters; by the library's own splitting where tables of letters may differ."""
        if word.isascii() and word.isalpha() and word.islower():
            return [word]
        if PLAIN.fullmatch(word):
            letters, low = self.letters, word.lower()
            parts = [low] if low.isalpha() else self.split.findall(low)
            return [p if p.isascii() else "".join([letters[b] for b in p.encode()]) for p in parts]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]

    def _by_pieces(self, words: list[str]) -> list[list[int]]:
        split = list(map(self._pieces, words))
        pieces = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        if self.by == "library":
            model = self.library.model
            ids = [[t.id for t in model.tokenize(p)] for p in pieces]
        else:
            ids = self.merges.encode([p + self.merges.end for p in pieces])
        return [ids[pieces[got[0]]] if len(got) == 1 else [i for p in got for i in ids[pieces[p]]] for got in split]

    def _learn(self, words: list[str]) -> None:
        odd = [w for w in words if any(s in w for s in self.special)] if self.special else []
        if odd:  # words that hold a special token's string
            self._store(odd, [e.ids for e in self.library.encode_batch_fast(odd, add_special_tokens=False)])
            words = [w for w in words if not any(s in w for s in self.special)]
        self._store(words, self._by_pieces(words))

    def _store(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._put(words, sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def _put(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        total, n, base = len(ids), len(self.at), self.used
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[base : base + total] = ids
        self.start[n : n + len(words)] = base + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += total
        self.held_bytes += sum(map(len, words)) + PER_WORD * len(words)

    def _ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, ends with a zero before them, ids) of the remembered words in `rows`."""
        sizes, starts = self.size[rows], self.start[rows]
        before = np.concatenate(([0], np.cumsum(sizes)))
        return sizes, before, self.flat[np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])]

    def _rows(self, distinct: list[str]) -> np.ndarray:
        """Where each word is remembered; new ones are learned. If they are too many, only these words stay."""
        rows = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(rows < 0)
        if not len(unknown):
            return rows
        new = [distinct[i] for i in unknown]
        if self.held_bytes + sum(map(len, new)) + PER_WORD * len(new) > self.most_bytes:
            known = np.flatnonzero(rows >= 0)
            sizes, _, ids = self._ids(rows[known])
            self._forget()
            self._put([distinct[i] for i in known], sizes, ids)
            rows[known] = np.arange(len(known))
        self._learn(new)
        rows[unknown] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not (self.special and pc.any(pc.match_substring_regex(texts, "|".join(map(regex.escape, self.special)))).as_py()):
            texts = loosened(texts)
        ends, words = words_of(texts)
        packed = words.dictionary_encode()
        rows = self._rows(packed.dictionary.to_numpy(zero_copy_only=False).tolist())  # far faster than to_pylist
        index = rows[packed.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        _, before, ids = self._ids(index)
        return before[ends], ids

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of the ids' tokens, joined by one space, special tokens kept."""
        return joined(offsets, self.names.take(pa.array(ids)))


def joined(offsets: np.ndarray, parts: pa.Array) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), parts), pa.scalar(" ", parts.type))


def loosened(texts: pa.Array) -> pa.Array:
    """The same tokens from fewer distinct words: A-Z lowered, and a space put between a letter or digit and a mark behind it.

    The splitting pattern never joins these two, and lower-casing is one of its normalisers. It comes after NFC, and some small
    letters compose with a mark where the capital does not; so a capital stays before what may be a combining mark."""
    size = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + size + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if size else np.zeros(0, np.uint8)
    low = _LOWER[data]
    if len(data) and data.max() >= _COMBINING:
        stays = np.flatnonzero((data[1:] >= _COMBINING) & (low[:-1] != data[:-1]))
        low[stays] = data[stays]
    data = low
    kind = _KIND[data]
    cut = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    ends = ends - (ends[0] if size else 0)
    data = np.insert(data, cut, 32)
    return pa.LargeStringArray.from_buffers(size, pa.py_buffer(ends + np.searchsorted(cut, ends)), pa.py_buffer(data))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: First bytes from here on may begin a combining mark; lower ones begin characters up to U+00FF.
_COMBINING = 0xC4
#: 1 for ASCII letters and digits, 2 for marks that may be cut off behind one.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(97, 123)]] = 1
_KIND[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 2  # all but the apostrophe, which begins 's and its like

_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, by: str = "speculate") -> WordEncoder:
    """One encoder for each vocabulary and worker process."""
    if (path, by) not in _ENCODERS:
        _ENCODERS[path, by] = WordEncoder(path, by)
    return _ENCODERS[path, by]


def digests(texts: pa.Array) -> list[str]:
    """sha256 of each text, lowercase hex."""
    data = memoryview(texts.buffers()[2] or b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", by: str = "speculate") -> DataFrame:
    """(id, ids array<int>) of each row; no shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, ids = encoder(path, by).encode(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    rows = chosen(docs, id=id_column, text=text_column)
    return rows.mapInArrow(per_slice(work), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            text = encoder(path).decode(offsets - offsets[0], lists.flatten().to_numpy().astype(np.uint32))
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=["id", "text"])

    return rows.select("id", "ids").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (encoded, then decoded), in one pass without a shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        offsets, ids = enc.encode(batch.column(1))
        numbers = enc.numbers
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(digests(joined(offsets, numbers.take(pa.array(ids))))), pa.array(digests(enc.decode(offsets, ids)))],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = chosen(docs, "doc_id", "text")
    return rows.mapInArrow(per_slice(work), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
