"""Long exact spans shared between texts, by recompression.

Rounds of recompression name runs of equal symbols and pairs of neighbouring symbols in all texts at once. A
name is a hash of what it stands for, so that equal content has the same name everywhere without a global
dictionary, and whether two neighbours merge depends on these two symbols only (left or right by a bit of
the name, and a cap on the length). Whether a position is a boundary of the last round is therefore decided
by the CONTEXT characters on either side of it: equal substrings have the same interior symbols.

Every text keeps, of any REACH + 1 neighbouring positions, the boundary whose surrounding 2 x CONTEXT
characters have the lowest hash. Any shared stretch of SPAN characters thus contains a kept boundary with
its surroundings, at the same place, in both texts. These high-level symbols reveal the candidates:

* boundaries whose surroundings occur in one document only are dropped;
* if all characters that any stretch around the boundary could hold (its reach) occur in two documents,
  every stretch around it is shared;
* otherwise the occurrences of the boundary are compared: where they fall into a few classes of equal reach, one
  of each class by its characters; where there are many, all stretches of SPAN characters around the boundary
  one by one by 128-bit hashes.

All groups are reduced by their lowest and highest doc_id, before the shuffle, so that a passage which a third
of all documents hold costs no more than its occurrences.

Defined cases: null texts and texts of fewer than SPAN characters share nothing; rows without doc_id are
left out; two rows of the same doc_id aren't two documents (if their texts differ, the spans of both come out
united); characters are Unicode code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.session import BROADCAST_ROWS, cut_table, lookup

SPAN = 200
#: The rounds: what is named and how long a name may get.
ROUNDS = (("runs", 4), ("pairs", 6), ("pairs", 8), ("pairs", 10), ("pairs", 12), ("pairs", 14))
#: Classes of a core that are compared directly, character by character; more are compared by hashes.
FEW = 16
#: Characters of a batch that are worked on together: their arrays stay in the cache of a core.
SLICE_CHARS = 50_000
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_SEEDS = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))


def context(rounds=ROUNDS) -> int:
    """How many characters on either side decide whether a position is a boundary of the last round.

    Naming runs looks as far as the cap and one symbol more; naming pairs looks at one symbol on either side.
    """
    c, longest = 0, 1
    for kind, cap in rounds:
        c += cap + longest if kind == "runs" else longest
        longest = max(longest, cap if kind == "runs" else min(cap, 2 * longest))
    return c


CONTEXT = context()
REACH = SPAN - 2 * CONTEXT
if REACH <= ROUNDS[-1][1]:
    raise ValueError("the rounds look too far for spans of this length")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    y = x >> _U(30)
    y ^= x
    y *= _U(0xBF58476D1CE4E5B9)
    y ^= y >> _U(27)
    y *= _U(0x94D049BB133111EB)
    y ^= y >> _U(31)
    return y


def recompress(codes: np.ndarray, text: np.ndarray, rounds=ROUNDS) -> np.ndarray:
    """First positions of the symbols of the last round; symbols never cross from one text to the next.

    Names are scrambled, so every round takes another bit of them for left and right. Only symbols that merge are named anew.
    """
    n = len(codes)
    name, at, size = mix(codes.astype(_U) + _U(1)), np.arange(n), np.ones(n, np.int16)
    opens = np.ones(n, bool)
    np.not_equal(text[1:], text[:-1], out=opens[1:])
    for r, (kind, cap) in enumerate(rounds):
        keep = np.ones(len(name), bool)
        if kind == "runs":  # equal names are of equal size
            i = np.flatnonzero((name[1:] == name[:-1]) & ~opens[1:])
            fresh = np.flatnonzero(np.diff(i, prepend=-2) > 1)
            first, count = i[fresh], np.diff(np.append(fresh, len(i))) + 1
            whole = count * size[first] <= cap
            first, count = first[whole], count[whole]
            name[first] = mix(name[first] + mix(count.astype(_U) + _U(1 << 32)))
            size[first] *= count.astype(np.int16)
            rest = count - 1
            keep[np.repeat(first + 1 - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())] = False
        else:
            left = (name >> _U(63 - r) & _U(1)).astype(bool)
            i = np.flatnonzero(left[:-1] & ~left[1:] & ~opens[1:] & (size[:-1] + size[1:] <= cap))
            name[i] = mix(name[i] * _U(3) + mix(name[i + 1] + _U(r + 1)))
            size[i] += size[i + 1]
            keep[i + 1] = False
        name, at, size, opens = name[keep], at[keep], size[keep], opens[keep]
    return at


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse up to n, remembered for slices of ordinary size."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) <= n:
        both = []
        for x in (int(base), pow(int(base), -1, 1 << 64)):
            p = np.full(max(n, SLICE_CHARS) + 1, x, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        have = (both[0], both[1])
        if n <= 2 * SLICE_CHARS:
            _POWERS[int(base)] = have
    return have


class Hashes:
    """Hashes of any substrings of a batch from running sums of powers, two of 64 bits."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.sums, self.back = [], []
        for base, seed in zip(_BASES, _SEEDS, strict=True):
            power, back = _powers(base, n)
            self.back.append(back)
            sums = np.empty(n + 1, _U)
            sums[0] = 0
            np.cumsum(mix(codes.astype(_U) + seed) * power[:n], out=sums[1:])
            self.sums.append(sums)

    def of(self, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mix((s[hi] - s[lo]) * self.back[which][lo] + (hi - lo).astype(_U))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i .. i + width - 1] for every i, by running values of blocks of ``width``."""
    n = len(x)
    fill = _U(2**64 - 1) if op is np.minimum else _U(0)
    pad = np.concatenate([x, np.full(-n % width + width, fill, _U)])
    blocks = pad.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def kept_boundaries(codes: np.ndarray, text: np.ndarray, starts: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Kept boundaries and the hashes of their surroundings."""
    at = recompress(codes, text)
    ends = np.append(starts[1:], len(codes))
    at = at[(at - CONTEXT >= starts[text[at]]) & (at + CONTEXT <= ends[text[at]])]
    core = hashes.of(at - CONTEXT, at + CONTEXT, 0)
    none = _U(2**64 - 1)
    grid = np.full(len(codes), none, _U)
    grid[at] = core
    width = REACH + 1
    low = _sliding(grid, width, np.minimum)  # of the stretch that starts here
    # the highest of the lows of the stretches that end here or later: equal to the own hash if it is the lowest of one
    shifted = np.concatenate([np.zeros(width - 1, _U), low])
    high = _sliding(np.where(shifted == none, _U(0), shifted), width, np.maximum)[: len(codes)]
    keep = high[at] == core
    return at[keep], core[keep]


def _slices(ids: list, texts: list, extra: list | None = None) -> Iterator[tuple]:
    """Texts in slices of about SLICE_CHARS characters as code points: (ids, codes, text of each code, starts, extra)."""
    lo, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i]) > SLICE_CHARS):
            if i > lo:
                part = texts[lo:i]
                n = np.array([len(t) for t in part])
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                yield ids[lo:i], codes, np.repeat(np.arange(len(part)), n), np.cumsum(n) - n, extra[lo:i] if extra else None
            lo, size = i, 0
        if i < len(texts):
            size += len(texts[i])


def anchors(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(core, full, doc_id, pos, right): the kept boundaries with the hashes of their surroundings and reach.

    Within a core, which is itself a hash of what all its members hold, 64 bits tell the reaches apart; ``right``
    is how far the reach goes to the right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, text, starts, _ in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes = Hashes(codes)
                at, core = kept_boundaries(codes, text, starts, hashes)
                begin, end = starts[text[at]], np.append(starts[1:], len(codes))[text[at]]
                lo, hi = np.maximum(begin, at + CONTEXT - span), np.minimum(end, at - CONTEXT + span)
                shape = mix((at - lo).astype(_U) << _U(32) | (hi - at).astype(_U))
                full = (hashes.of(lo, hi, 1) ^ shape).view(np.int64)
                doc = np.array(ids, np.int64)[text[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(full), pa.array(doc), pa.array((at - begin).astype(np.int32)), pa.array((hi - at).astype(np.int32))],
                    ["core", "full", "doc_id", "pos", "right"],
                )

    long_enough = documents.filter(F.col("doc_id").isNotNull() & (F.char_length("text") >= span)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return long_enough.mapInArrow(run, "core long, full long, doc_id long, pos int, right int")


def stretches(wanted: DataFrame, span: int = SPAN) -> DataFrame:
    """(hash1, hash2, doc_id, start, asked): the stretches of ``span`` characters around given boundaries.

    ``wanted``: (doc_id, text, at array<struct<pos,asked>>). A stretch around several boundaries comes once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, _, starts, at in _slices(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                hashes = Hashes(codes)
                mark = np.zeros((2, len(codes) + 1), np.int32)
                ends = np.append(starts[1:], len(codes))
                for i, places in enumerate(at):
                    pos = np.array([p["pos"] for p in places]) + starts[i]
                    asked = np.array([p["asked"] for p in places], np.int64)
                    inside = (pos + CONTEXT <= ends[i]) & (ends[i] - starts[i] >= span)
                    pos, asked = pos[inside], asked[inside]
                    lo, hi = np.maximum(starts[i], pos + CONTEXT - span), np.minimum(ends[i] - span, pos - CONTEXT) + 1
                    np.add.at(mark, (asked, lo), 1)
                    np.add.at(mark, (asked, hi), -1)
                on = np.cumsum(mark, axis=1)[:, :-1] > 0
                first = np.flatnonzero(on[0] | on[1])
                text = np.searchsorted(starts, first, side="right") - 1
                h = [hashes.of(first, first + span, k).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[0]), pa.array(h[1]), pa.array(np.array(ids, np.int64)[text]), pa.array((first - starts[text]).astype(np.int32)), pa.array(on[1][first])],
                    ["hash1", "hash2", "doc_id", "start", "asked"],
                )

    return wanted.mapInArrow(run, "hash1 long, hash2 long, doc_id long, start int, asked boolean")


def surroundings(wanted: DataFrame, span: int = SPAN) -> DataFrame:
    """(core, full, lo, hi, before, after): the texts on both sides of given boundaries, as far as they reach.

    ``wanted``: (doc_id, text, at array<struct<core,full,lo,hi,pos>>). A class comes once per document.
    """
    reach, names = span - CONTEXT, ("core", "full", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2)
            cell, owner = at.flatten(), np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy())
            _, once = np.unique(np.stack([owner, *(cell.field(x).to_numpy() for x in names[:2])]), axis=1, return_index=True)
            cell, owner = cell.take(pa.array(once)), owner[once]
            texts, pos = b.column(1).to_pylist(), cell.field("pos").to_pylist()
            before = [texts[i][max(0, p - reach) : p] for i, p in zip(owner.tolist(), pos, strict=True)]
            after = [texts[i][p : p + reach] for i, p in zip(owner.tolist(), pos, strict=True)]
            yield pa.RecordBatch.from_arrays([*(cell.field(x) for x in names), pa.array(before, pa.string()), pa.array(after, pa.string())], [*names, "before", "after"])

    return wanted.mapInArrow(run, "core long, full long, lo long, hi long, before string, after string")


def _matrix(texts: list[str], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of short texts, one per row, and their lengths."""
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), n)
    column = np.arange(len(codes)) - (np.cumsum(n) - n)[row]
    out = np.zeros((len(texts), width), np.uint32)
    out[row, n[row] - 1 - column if backwards else column] = codes
    return out, n


def compare_classes(groups: DataFrame, span: int = SPAN) -> DataFrame:
    """(core, full, a, z): what each lone occurrence shares with the other classes of its core, by characters.

    ``groups``: (core, of array<struct<full,lo,hi,before,after>>), of at most FEW classes each.
    """
    width = span - CONTEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(1)
            k, cell = of.value_lengths().to_numpy().astype(np.int64), of.flatten()
            lo, hi = cell.field("lo").to_numpy(), cell.field("hi").to_numpy()
            left, ln = _matrix(cell.field("before").to_pylist(), width, True)
            right, rn = _matrix(cell.field("after").to_pylist(), width, False)
            group = np.repeat(np.arange(len(k)), k)
            # the other classes of its core for every class, FEW - 1 at most
            i = np.repeat(np.arange(len(group)), k[group])
            j = (np.cumsum(k) - k)[group[i]] + np.arange(len(i)) - (np.cumsum(k[group]) - k[group])[i]
            ok = (i != j) & (lo[i] == hi[i]) & ((lo[j] != lo[i]) | (hi[j] != lo[i]))
            i, j = i[ok], j[ok]
            found = []
            for at in range(0, len(i), 16_384):
                x, y = i[at : at + 16_384], j[at : at + 16_384]
                ends = []
                for m, n in ((left, ln), (right, rn)):
                    differ = np.concatenate([m[x] != m[y], np.ones((len(x), 1), bool)], 1).argmax(1)
                    ends.append(np.minimum(np.minimum(differ, n[x]), n[y]))
                good = ends[0] + ends[1] >= span
                found.append(np.stack([x[good], -ends[0][good], ends[1][good]]))
            r = np.unique(np.concatenate(found, 1), axis=1) if found else np.empty((3, 0), np.int64)
            at = pa.array(r[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(group[r[0]])), cell.field("full").take(at), pa.array(r[1].astype(np.int32)), pa.array(r[2].astype(np.int32))],
                ["core", "full", "a", "z"],
            )

    return groups.mapInArrow(run, "core long, full long, a int, z int")


def shared_spans(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, span_start, span_end): the longest unbroken stretches of characters shared with another document."""
    found = cut_table(anchors(documents, span))
    alike = ["core", "full"]
    # most boundaries stand in one document only: they are dropped first, by one number pair per core
    twice = cut_table(found.groupBy("core").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi").select("core"))
    some = cut_table(lookup(found, twice, ["core"], "doc_id", "left_semi"))
    classes = some.groupBy(*alike).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    cores = classes.groupBy("core").agg(F.max((F.col("lo") == F.col("hi")).cast("int")).alias("open"), F.count("*").alias("kinds"))
    shared = cores.select("core", (F.col("open") == 1).alias("compare"), (F.col("kinds") <= FEW).alias("few"))
    status = cut_table(classes.join(shared, "core").select(*alike, "lo", "hi", (F.col("lo") < F.col("hi")).alias("whole"), "compare", "few"))
    marked = cut_table(lookup(some, status, alike, "doc_id").select(*alike, "doc_id", "pos", "right", "lo", "hi", "whole", "compare", "few"))
    certain = marked.filter("whole").select("doc_id", F.greatest(F.lit(0), F.col("pos") + (CONTEXT - span)).alias("a"), (F.col("pos") + F.col("right")).alias("z"))

    # the texts of all documents with a boundary to compare, joined once. Cores of few classes: the first document of
    # a class stands for it. Cores of many: every occurrence that is alone with its reach, and two witnesses of a class
    as_class = F.when(F.expr("few and doc_id = lo"), F.struct(*alike, "lo", "hi", "pos"))
    as_place = F.when(F.expr("not few and (not whole or doc_id = lo or doc_id = hi)"), F.struct("pos", (~F.col("whole")).cast("int").alias("asked")))
    places = marked.filter("compare").groupBy("doc_id").agg(F.collect_list(as_class).alias("classes"), F.collect_list(as_place).alias("places"))
    places = cut_table(places.filter("size(classes) + size(places) > 0"))
    long_enough = documents.filter(F.char_length("text") >= span).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    entries = places.agg(F.sum(F.size("classes") + F.size("places"))).first()[0] or 0
    near = cut_table(long_enough.join(F.broadcast(places) if entries <= BROADCAST_ROWS else places, "doc_id"))  # texts move only beyond that

    around = surroundings(near.select("doc_id", "text", "classes"), span)
    groups = around.groupBy("core").agg(F.collect_list(F.struct("full", "lo", "hi", "before", "after")).alias("of"))
    lone = marked.filter("compare and few and not whole").select(*alike, "doc_id", "pos")
    by_class = lookup(lone, cut_table(compare_classes(groups, span)), alike, "doc_id").select("doc_id", (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("z")).alias("z"))

    looked = cut_table(stretches(near.filter("size(places) > 0").select("doc_id", "text", "places"), span))
    same = cut_table(looked.groupBy("hash1", "hash2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("hash1", "hash2"))
    by_stretch = lookup(looked.filter("asked"), same, ["hash1", "hash2"], "doc_id").select("doc_id", F.col("start").alias("a"), (F.col("start") + span).alias("z"))
    return join_spans(certain.unionByName(by_class).unionByName(by_stretch))


def join_spans(parts: DataFrame) -> DataFrame:
    """Unite overlapping and touching parts [a, z) of every document."""
    w = Window.partitionBy("doc_id").orderBy("a", "z")
    fresh = (F.col("a") > F.coalesce(F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    numbered = parts.distinct().withColumn("_new", fresh).withColumn("_span", F.sum("_new").over(w))
    return numbered.groupBy("doc_id", "_span").agg(F.min("a").cast("int").alias("span_start"), F.max("z").cast("int").alias("span_end")).drop("_span")


def shared_amounts(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document; 0 of a null or empty text, share null."""
    spans = shared_spans(documents, span).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return docs.join(spans, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).alias("shared_share"))
