"""Toxicity scores of texts restored by a noisy-channel decoder.

The channel: a writer may put look-alikes for letters (leetspeak), masks, repeated letters, and marks or
blanks between letters; a run of more than `MASK_RUN` masks is decoration. A token that is not plain letters
is a lattice of the letters each character may stand for; an exact list-Viterbi search over it (the
`READINGS` best of each state of two letters) under a character trigram model, counted over all texts of the
corpus, returns the best readings. A plain token is its own only reading.

The scorer learns from labelled rows: word features (the word, its beginnings, its inner letter runs) get
their log-odds between toxic and clean documents; a text's evidence is its strongest word and how many
words are strong, and a logistic regression turns that into a score. At most `SAMPLE` labelled rows, chosen
by a hash of doc_id, are learned from (a bound of the training data alone). When texts are scored, a token
is decoded only if some path of its lattice spells a known feature: the readings of any other token cannot
score. In a run of single characters every stretch that may spell a feature is decoded as a token.

Defined results: null and empty texts have no words and get the score of no evidence; without labelled rows
of both classes every score is 0; repeated rows give repeated rows; a null doc_id is not held out; a text of
characters outside the letters of the model is scored by the features of its words as they stand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, drop_table, flat, place, per_slice, table, trim, words_of, written

SAMPLE, REMEMBERED, COUNTED_BYTES = 12_000, 150_000, 1 << 20
FOLDS = 5
#: A feature counts if it is in this share of the toxic training texts, and has these log-odds, at least.
LEAST_SHARE, LEAST_WEIGHT = 0.01, 3.5
#: Letters of the character model: a-z and U+00DF-U+00FF; 0 is what stands between words.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
N = len(LETTERS) + 1
#: Letters that a look-alike may stand for.
ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "¡": "i", "€": "e", "£": "l", "¢": "c",
}
MASKS = "*#%&_?"
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¡¿"
#: Marks around a token that never stand for a letter.
OUTER = ".,;:\"')[]{}«»“”„…–—¿"
#: Costs (nats) of what the channel does to a letter.
COST_ALIKE, COST_MASK, COST_MARK, COST_AGAIN, READINGS = 1.0, 4.0, 1.5, 0.5, 4

#: Masks in a row that may each hide a letter; tokens up to this length are remembered; readings of a small lattice.
MASK_RUN, LONGEST_REMEMBERED, FEW = 4, 200, 16

_CODE = np.zeros(0x100, np.uint8)
_CODE[[ord(c) for c in LETTERS]] = np.arange(1, N)
_AT = {c: i + 1 for i, c in enumerate(LETTERS)}
_TWICE = re.compile(r"(.)\1", re.S)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each letter triple occurs in all texts (lower-cased); N**3 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        total = np.zeros(N**3, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0), COUNTED_BYTES):
                part = pc.utf8_lower(pc.fill_null(batch.column(0).slice(a, b - a), "")).to_pylist()
                points = np.frombuffer((" ".join(part) + "  ").encode("utf-32-le", "replace"), np.uint32)
                code = np.where(points < 0x100, _CODE[np.minimum(points, 0xFF)], 0).astype(np.int32)
                total += np.bincount((code[:-2] * N + code[1:-1]) * N + code[2:], minlength=N**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    counts = np.zeros(N**3, np.int64)
    got = chosen(docs, "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # N**3 rows at most
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), trigrams backed off to bigrams and letters."""
    three = counts.reshape(N, N, N).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + N)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3)


def options(char: str) -> tuple[list[tuple[int, float]], float | None]:
    """(code, cost) of the letters a character may stand for, and the cost of dropping it as a mark."""
    if char in _AT:
        return [(_AT[char], 0.0)], None
    found = [(_AT[c], COST_ALIKE) for c in ALIKE.get(char, "")]
    if char in MASKS:
        found += [(c, COST_MASK) for c in range(1, 27)]
    if not char.isalnum():
        return found, COST_MARK
    return found, None if found else 3 * COST_MARK


_OPTIONS: dict[str, tuple[list[tuple[int, float]], float | None]] = {}
#: Letters, marks that are no look-alikes, and masks at the end.
_MASKED_END = re.compile("([%s]+)[^\\w\\s%s]*([%s]{1,%d})" % (LETTERS, re.escape("".join(ALIKE) + MASKS), re.escape(MASKS), MASK_RUN))
_LONG_MASK = re.compile("[" + re.escape(MASKS) + "]{%d,}" % (MASK_RUN + 1))


def lattice(token: str) -> list[tuple[list[tuple[int, float]], float | None]]:
    """The options of each character."""
    for char in set(token) - _OPTIONS.keys():
        if len(_OPTIONS) > 10_000:
            _OPTIONS.clear()
        _OPTIONS[char] = options(char)
    found = [_OPTIONS.get(c) or options(c) for c in token]
    for m in _LONG_MASK.finditer(token):
        found[m.start() : m.end()] = [([], COST_MARK)] * (m.end() - m.start())
    return found


class Decoder:
    """List-Viterbi search under a character model, best first; readings share their beginnings as nodes of a tree."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.pair = model.min(0)  # least price of a letter behind a letter
        self.behind = np.ascontiguousarray(self.pair.T)
        self.rows: dict[int, list[float]] = {}

    def row(self, a: int, b: int) -> list[float]:
        got = self.rows.get(a * N + b)
        if got is None:
            got = self.rows[a * N + b] = self.model[a, b].tolist()
        return got

    def bounds(self, steps) -> list[list[float]]:
        """For each place and last letter a lower bound of what is still to be paid."""
        ahead = self.pair[:, 0]
        found = [ahead.tolist()]
        for choice, drop in reversed(steps):
            now = np.full(N, math.inf) if drop is None else ahead + drop
            if len(choice) > 3:  # a mask: all letters of one price, and maybe look-alikes
                codes, prices = (np.array(v) for v in zip(*choice, strict=True))
                now = np.minimum(now, (self.pair[:, codes] + (prices + ahead[codes])).min(1))
                now[codes] = np.minimum(now[codes], prices + COST_AGAIN + ahead[codes])
            else:
                for c, price in choice:
                    again = min(now[c], price + COST_AGAIN + ahead[c])
                    now = np.minimum(now, self.behind[c] + (price + ahead[c]))
                    now[c] = min(now[c], again)
            ahead = now
            found.append(ahead.tolist())
        return found[::-1]

    def readings(self, token: str) -> list[str]:
        """The READINGS best readings of a token, the best first.

        A word with masks behind it has its own formula (`_masked_end`), a lattice of few paths is walked whole. In
        others prefixes are followed in the order of their cost and the bound of the rest, at most READINGS for each place
        and state of two letters: no more of them can be in the READINGS best."""
        m = _MASKED_END.fullmatch(token)
        ended = self._masked_end(m[1], len(m[2])) if m else None
        if ended is not None:
            return ended
        steps = lattice(token)
        few = self._few(steps) if len(steps) <= LONGEST_REMEMBERED else None
        if few is not None:
            return few
        ahead, end = self.bounds(steps), len(steps)
        parent, last, child = [0], [0], {}
        # (bound, place, node, cost, siblings that cost more, the next of them): siblings wait until their better one was taken
        queue: list[tuple] = [(ahead[0][0], 0, 0, 0.0, (), 0)]
        seen: set[tuple[int, int]] = set()
        taken: dict[tuple[int, int, int], int] = {}
        found: list[str] = []
        while queue:
            _, at, node, cost, siblings, k = heappop(queue)
            if k < len(siblings):
                bound, to, new = siblings[k]
                heappush(queue, (bound, at, self._child(to, parent, last, child), new, siblings, k + 1))
            if at > end:
                letters = []
                while node:
                    letters.append(LETTERS[last[node] - 1])
                    node = parent[node]
                found.append("".join(reversed(letters)))
                if len(found) == READINGS:
                    break
                continue
            if (at, node) in seen:
                continue
            seen.add((at, node))
            a, b = last[parent[node]], last[node]
            state = (at, a, b)
            n = taken.get(state, 0)
            if n == READINGS:
                continue
            taken[state] = n + 1
            if at == end:
                if node:
                    total = cost + self.row(a, b)[0]
                    heappush(queue, (total, end + 1, node, total, (), 0))
                continue
            choice, drop = steps[at]
            rest = ahead[at + 1]
            if drop is not None:
                heappush(queue, (cost + drop + rest[b], at + 1, node, cost + drop, (), 0))
            if choice:
                prices = self.row(a, b)
                ways = tuple(sorted([(new + rest[c], node * N + c, new) for c, price in choice for new in (cost + price + prices[c],)]))
                bound, to, new = ways[0]
                heappush(queue, (bound, at + 1, self._child(to, parent, last, child), new, ways, 1))
                for c, price in choice:
                    if c == b:  # written again
                        new = cost + price + COST_AGAIN
                        heappush(queue, (new + rest[b], at + 1, node, new, (), 0))
        return found

    @cached_property
    def _tails(self) -> tuple[list, list, list]:
        """By the last two letters: the best letters that may end the word, their prices with the end, and the least price of two letters and the end."""
        letters = slice(1, 27)
        one = self.model[:, :, letters] + self.model[:, letters, 0][None]
        best = np.argsort(one, axis=2, kind="stable")[:, :, :READINGS]
        two = (self.model[:, letters, letters] + self.model[letters, letters, 0][None]).min(2)
        return (best + 1).tolist(), np.take_along_axis(one, best, 2).tolist(), (self.model[:, :, letters] + two[None]).min(2).tolist()

    def _masked_end(self, word: str, masks: int) -> list[str] | None:
        """The word's readings alone and with one letter for one of the masks, if none with more letters can be among the best; else None."""
        held = self._walk(lattice(word))
        if held is None:
            return None
        letters, prices, two = self._tails
        alone, one = COST_MARK * masks, COST_MASK + COST_MARK * (masks - 1)
        more = [2 * COST_MASK + COST_MARK * (masks - 2), 3 * COST_MASK + COST_MARK * (masks - 3)]
        found, least = [], math.inf
        for text, (cost, a, b) in held.items():
            found.append((cost + alone + self.row(a, b)[0], text))
            found += [(cost + one + p, text + LETTERS[c - 1]) for c, p in zip(letters[a][b], prices[a][b], strict=True)]
            if masks > 1:
                least = min(least, cost + more[0] + two[a][b])
            if masks > 2:
                least = min(least, cost + more[1])
        found = sorted(found)
        texts = list(dict.fromkeys(text for _, text in found))[:READINGS]
        price = {text: cost for cost, text in reversed(found)}
        return texts if all(price[t] + 1e-9 < least for t in texts) else None

    def _few(self, steps) -> list[str] | None:
        """The same for a lattice that never has more than FEW readings so far; None for any other."""
        held = self._walk(steps)
        return held and [text for _, text in sorted((cost + self.row(a, b)[0], text) for text, (cost, a, b) in held.items() if text)][:READINGS]

    def _walk(self, steps) -> dict[str, tuple[float, int, int]] | None:
        """text -> (cost, its last two letters) of all readings, if they never are more than FEW."""
        held = {"": (0.0, 0, 0)}
        for choice, drop in steps:
            if len(held) * len(choice) > 2 * FEW:
                return None
            step: dict[str, tuple[float, int, int]] = {}
            for text, (cost, a, b) in held.items():
                if drop is not None:
                    old = step.get(text)
                    if old is None or cost + drop < old[0]:
                        step[text] = (cost + drop, a, b)
                for c, price in choice:
                    longer, new = text + LETTERS[c - 1], cost + price + self.row(a, b)[c]
                    old = step.get(longer)
                    if old is None or new < old[0]:
                        step[longer] = (new, b, c)
                    if c == b:  # written again
                        new = cost + price + COST_AGAIN
                        old = step.get(text)
                        if old is None or new < old[0]:
                            step[text] = (new, a, b)
            if len(step) > FEW:
                return None
            held = step
        return held

    @staticmethod
    def _child(key: int, parent: list[int], last: list[int], child: dict[int, int]) -> int:
        """The node of parent * N + letter."""
        to = child.get(key)
        if to is None:
            to = child[key] = len(parent)
            parent.append(key // N)
            last.append(key % N)
        return to


class Lexicon:
    """Known features as trees of letters (from node 0 all, from 1 beginnings and whole words, from 2 inner runs), and which tokens have a lattice that may spell one."""

    def __init__(self, features):
        self.kids: list[dict[int, int]] = [{}, {}, {}]
        self.last, self.ends = [0, 0, 0], [False, False, False]
        others = set()  # features that no lattice spells
        for f in sorted(set(features)):
            bare = f.lstrip("=^")
            if not all(c in _AT for c in bare):
                others.add(bare)
                continue
            self._add(0, bare)
            self._add(1 if f != bare else 2, bare)
        self.others = re.compile("|".join(map(re.escape, sorted(others)))) if others else None

    def _add(self, node: int, letters: str) -> None:
        for c in letters:
            code = _AT[c]
            to = self.kids[node].get(code)
            if to is None:
                to = self.kids[node][code] = len(self.kids)
                self.kids.append({})
                self.last.append(code)
                self.ends.append(False)
            node = to
        self.ends[node] = True

    def _pattern(self, own, filler, before: str) -> re.Pattern:
        """The trees as a pattern: `own(code)` matches a letter, `filler(code)` what may follow it inside a word, `before` what may stand before a word."""

        def below(node: int) -> str:
            if self.ends[node] or not self.kids[node]:
                return ""
            parts = [own(code) + ("" if self.ends[to] else filler(code)) + below(to) for code, to in sorted(self.kids[node].items())]
            return "(?:" + "|".join(parts) + ")" if len(parts) > 1 else parts[0]

        parts = [p for p in (below(2), f"^{before}{below(1)}" if self.kids[1] else "") if p]
        return re.compile("|".join(parts) or r"(?!)", re.M)

    @cached_property
    def literal(self) -> re.Pattern:
        return self._pattern(lambda code: LETTERS[code - 1], lambda code: "", "")

    @cached_property
    def disguised(self) -> re.Pattern:
        """Matches every token that may spell a feature, and few others: marks and repetitions may stand behind each letter."""
        makers = {code: "".join(sorted(k for k in {*ALIKE, *LETTERS} if any(c == code for c, _ in options(k)[0]))) for code in range(1, N)}
        firm = re.escape(LETTERS + "".join(c for c in ALIKE if c.isalnum()))  # never dropped
        own = lambda code: "[" + re.escape(makers[code] + MASKS) + "]"
        return self._pattern(own, lambda code: f"(?:{own(code)}|[^{firm}\\n])*", f"[^{firm}\\n]*")

    def candidates(self, tokens: list[str]) -> list[bool]:
        """Which tokens may score; all that may are among them. Long ones are left to `spans`, whose work is linear."""
        out = [len(t) > LONGEST_REMEMBERED or (self.others is not None and self.others.search(t) is not None) for t in tokens]
        for kind, pattern in ((True, self.literal), (False, self.disguised)):
            own = [i for i, t in enumerate(tokens) if not out[i] and plain(t) is kind]
            line = "\n".join([tokens[i] for i in own])
            ends = np.cumsum([len(tokens[i]) + 1 for i in own])
            at = 0
            while (m := pattern.search(line, at)) is not None:
                k = int(np.searchsorted(ends, m.start(), side="right"))
                out[own[k]] = True
                at = int(ends[k])
        return out

    def spans(self, token: str, every: bool = False) -> list[tuple[int, int]]:
        """(start, stop) of stretches that may spell a feature; the first alone unless `every`.

        With `every` a stretch starts at any character that is no mask, and each start is followed by itself."""
        kids, last, ends, found = self.kids, self.last, self.ends, []
        active: set[tuple[int, int]] = set()
        for at, (choice, drop) in enumerate(lattice(token)):
            step = set()
            codes = [c for c, _ in choice]
            begins = at if every else 0
            for node, start in [*active, (0, begins)] if not every or len(codes) < 26 else active:
                if drop is not None and node:
                    step.add((node, start))
                own = kids[node]
                for c in own.keys() & codes if len(codes) > 4 else codes:
                    to = own.get(c)
                    if to is not None:
                        if ends[to]:
                            found.append((start, at + 1))
                            if not every:
                                return found
                        step.add((to, start))
                if node and last[node] in codes:
                    step.add((node, start))
            active = step
        return found


def word_features(word: str) -> list[str]:
    """The word, its beginnings and its inner runs of letters."""
    n = len(word)
    found = ["=" + word]
    found += ["^" + word[:k] for k in range(4, min(n, 8) + 1)]
    found += [word[i : i + 5] for i in range(n - 4)]
    return found


def plain(token: str) -> bool:
    """Whether a token is letters alone, none of them doubled."""
    return token.isalpha() and not _TWICE.search(token)


@dataclass
class Scorer:
    """Restores tokens and scores words; remembers a bounded number of them."""

    model: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    fitted: tuple[float, float, float] | None = None
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"model": self.model, "weights": self.weights, "fitted": self.fitted, "known": {}}

    @cached_property
    def decoder(self) -> Decoder:
        return Decoder(self.model)

    @cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(list(self.weights))

    def restored(self, token: str, all_readings: bool = True) -> list[str]:
        """The token without marks around it, and its readings; unless `all_readings`, a long one without known features has none."""
        bare = token.strip(MARKS)
        found = [bare] if bare else []
        if plain(token):
            return found
        for core in dict.fromkeys((token.strip(OUTER), token.strip(OUTER + "(!?"))):
            if core and not plain(core) and any(c in _AT for c in core) and (all_readings or len(core) <= LONGEST_REMEMBERED or self.lexicon.spans(core)):
                found += self.decoder.readings(core)
        return list(dict.fromkeys(found))

    def score(self, token: str) -> float:
        return self.scores([token])[0]

    def scores(self, tokens: list[str]) -> list[float]:
        """The strongest feature of each token's readings; 0 without any."""
        known, get = self.known, self.weights.get
        new = [t for t in tokens if t not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = tokens
        own: dict[str, float] = {}
        for token, may in zip(new, self.lexicon.candidates(new), strict=True):
            got = max((get(f, 0.0) for word in self.restored(token, False) for f in word_features(word)), default=0.0) if may else 0.0
            (known if len(token) <= LONGEST_REMEMBERED else own)[token] = got
        return [own[t] if t in own else known[t] for t in tokens]

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(strongest word, log of 1 + strong words) of each text."""
        offsets, words = words_of(pc.utf8_lower(pc.fill_null(texts, "")))
        strongest, strong = np.zeros(len(texts)), np.zeros(len(texts))
        if len(words):
            packed = words.dictionary_encode()
            distinct, codes = packed.dictionary.to_pylist(), packed.indices.to_numpy()
            value = np.array(self.scores(distinct), float)[codes]
            full = np.diff(offsets) > 0
            strongest[full] = np.maximum.reduceat(value, offsets[:-1][full])
            strong = np.diff(np.concatenate(([0], np.cumsum(value > 0)))[offsets]).astype(float)
            for doc, spaced in self._spaced(distinct, codes, offsets):
                s = max((self.score(spaced[i:j]) for i, j in self.lexicon.spans(spaced, every=True)), default=0.0)
                strongest[doc], strong[doc] = max(strongest[doc], s), strong[doc] + (s > 0)
        return strongest, np.log1p(strong)

    def _spaced(self, distinct: list[str], codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str]]:
        """(text, letters put together) of runs of three or more single characters."""
        single = np.fromiter((len(w) == 1 for w in distinct), bool, len(distinct))[codes].astype(np.int8)
        edge = np.diff(np.concatenate(([0], single, [0])))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= 3:
                cuts = [a, *offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)], b]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi - lo >= 3:
                        yield int(np.searchsorted(offsets, lo, side="right") - 1), "".join(distinct[c] for c in codes[lo:hi])

    def probability(self, strongest: np.ndarray, strong: np.ndarray) -> np.ndarray:
        if self.fitted is None:
            return np.zeros(len(strongest))
        a, b, c = self.fitted
        return 1 / (1 + np.exp(-np.clip(a * strongest + b * strong + c, -500, 500)))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 0 by `FOLDS`."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, label) of at most `limit` labelled rows that are not held out."""
    ids = chosen(labels, doc_id="doc_id", label="toxic").withColumn("label", F.col("label").cast("int"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    few = ids.orderBy(F.xxhash64("doc_id"), "label").limit(limit)
    return chosen(docs, "doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label")  # `limit` rows at most


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Scorer:
    spark = docs.sparkSession
    scorer = Scorer(language_model(trigram_counts(docs)))
    rows = written(training_rows(docs, labels, limit))  # `limit` rows at most
    shared = spark.sparkContext.broadcast(scorer)  # N**3 probabilities

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, (Counter(), Counter())
        held: dict[str, list[str]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for token in set((text or "").lower().split()):
                    got = held.get(token)
                    if got is None:
                        got = own.restored(token)
                        if len(held) >= REMEMBERED // 4:
                            held.clear()
                        if len(token) <= LONGEST_REMEMBERED:
                            held[token] = got
                    for word in got:
                        found.update(word_features(word))
                seen[label].update(found)
                seen[label][""] += 1  # documents
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield _table(seen)
                    seen = (Counter(), Counter())
        yield _table(seen)
        trim()

    sized = rows.repartition(spark.sparkContext.defaultParallelism)
    counts = sized.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts.where("toxic >= 3 OR feature = ''"))
    shared.destroy()
    total = counts.where("feature = ''").first()
    if total is not None and total["clean"] and total["toxic"]:
        n0, n1 = total["clean"], total["toxic"]
        weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
        strong = counts.where(F.col("feature") != "").where(F.col("toxic") >= max(3, math.ceil(LEAST_SHARE * n1))).withColumn("w", weight).where(F.col("w") > LEAST_WEIGHT)
        # 1 / LEAST_SHARE times the features of a toxic text at most
        scorer.weights = {r["feature"]: r["w"] for r in strong.orderBy(F.desc("w"), "feature").collect()}
        again = spark.sparkContext.broadcast(scorer)

        def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = again.value.evidence(batch.column(0))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(1)], names=["strongest", "strong", "label"])

        got = sized.mapInArrow(per_slice(evidence), "strongest double, strong double, label int").toArrow()
        scorer.fitted = _fit(*(got.column(c).to_numpy().astype(float) for c in ("strongest", "strong", "label")))
        again.destroy()
    drop_table(rows)
    drop_table(counts)
    return scorer


def _table(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(seen[0] | seen[1])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], names=["feature", "clean", "toxic"])


def _fit(strongest: np.ndarray, strong: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small penalty; rows are put in one order first."""
    x = np.stack((strongest, strong, np.ones(len(label))), 1)
    order = np.lexsort((label, strong, strongest))
    x, y, w = x[order], label[order], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - y) + 0.1 * w * [1, 1, 0]
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag([0.1, 0.1, 1e-6])
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of each row, and all columns of `docs` under c0, c1, … in their order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        from .common import slices

        own = shared.value
        return pa.array(np.concatenate([np.zeros(0), *(own.probability(*own.evidence(texts.slice(a, b - a))) for a, b in slices(texts))]))

    rows = flat(docs)
    return rows.select(F.col(place(docs, "doc_id")).alias("doc_id"), score(F.col(place(docs, "text"))).alias("score"), *rows.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, scorer).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
