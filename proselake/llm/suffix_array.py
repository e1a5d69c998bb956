"""Exact substring deduplication (operator 8) over suffix arrays sorted in two stages.

A window is a 50-byte string of one document. Windows that are equal meet by the smallest hash among their 20-byte
grams: consecutive windows with the same smallest gram form one record, and records are dealt to buckets by that gram.

1. Documents are dealt to groups by a hash of their id, once; the exchange is used again by steps 2 and 4.
   Each group sends its distinct grams to the grams' buckets, which send back those that several documents hold. Grams that
   more than `hot_groups` groups hold with many different records, as those of a common line, are hot: what stands around the
   line would meet in one bucket.
   For them groups send the hashes of whole windows as well, and go on with the windows that several documents hold.
2. Each group cuts the records with such a gram out of its texts, those of hot grams down to their shared windows. Equal
   records of one group are sent once, for the smallest document; the others are covered by it already.
3. Each bucket sorts the suffixes that start a window: suffixes smaller than their successors directly, the rest by bucket
   scans. Adjacent suffixes with a common prefix of a window's length form runs; a run's smallest document keeps its copy.
4. Each group applies the covered spans to its texts.

Grams and spans travel as packed arrays, a row for each pair of group and bucket, and no group of copies meets anywhere as
rows: a bucket gets a record once for each group of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 20
SEGMENT = 1 << 20
LONGEST_RUN = 256
NO_ID = (1 << 63) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(buf: np.ndarray, kind: str, at: int, n: int) -> np.ndarray:
    """Integers that start at each of n bytes from `at`."""
    return np.ndarray((n,), kind, buffer=buf, offset=at, strides=(1,))


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Odd 64-bit hash of the gram at each byte."""
    n = len(buf) - GRAM + 1
    h = _words(buf, "<u8", 0, n) * _MIX[0]
    h ^= h >> np.uint64(32)
    h += _words(buf, "<u8", 8, n) * _MIX[1]
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    h += _words(buf, "<u4", 16, n).astype(np.uint64) * _MIX[2]
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h | np.uint64(1)


def _window_minima(h: np.ndarray, wide: int) -> np.ndarray:
    m, span = h, 1
    while 2 * span <= wide:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < wide:
        rest = wide - span
        m = np.minimum(m[:-rest], m[rest:])
    return m


def _segments(texts: list[bytes], window: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to about SEGMENT bytes, long ones in parts that overlap by a window less a byte: bytes, and each part's text, place in the text and place in the bytes (and, last, the end)."""
    parts, doc, place, at, size = [], [], [], [0], 0
    for k, t in enumerate(texts):
        for s in range(0, max(1, len(t) - window + 1), SEGMENT):
            part = t[s : s + SEGMENT + window - 1]
            if len(part) < window:
                continue
            parts.append(part)
            doc.append(k)
            place.append(s)
            size += len(part)
            at.append(size)
            if size >= SEGMENT:
                yield b"".join(parts), np.array(doc), np.array(place), np.array(at)
                parts, doc, place, at, size = [], [], [], [0], 0
    if parts:
        yield b"".join(parts), np.array(doc), np.array(place), np.array(at)


def _window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Odd 64-bit hash of the window at each byte, from those of grams that cover it."""
    n = len(h) - (window - GRAM)
    out = np.zeros(n, np.uint64)
    for at in (*range(0, window - GRAM, GRAM), window - GRAM):
        out = (out ^ h[at : at + n]) * _MIX[0]
        out ^= out >> np.uint64(31)
    return out | np.uint64(1)


def records(texts: list[bytes], window: int, hashes: bool = False, digests: bool = False) -> Iterator[tuple]:
    """Runs of windows with one smallest gram: (gram, text, first window's place, number of windows) and, if asked for, a digest of 8 bits of each run, or where they begin in the hashes of all windows of their segment, and these."""
    for raw, doc, place, at in _segments(texts, window):
        buf = np.frombuffer(raw + b"\0" * 8, np.uint8)[: len(raw)]
        h = _gram_hashes(buf)
        m = _window_minima(h, window - GRAM + 1)
        for end in at[1:-1]:
            m[end - window + 1 : end] = 0
        starts = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(m)))
        keep = m[starts] != 0
        starts, sizes = starts[keep], sizes[keep]
        if len(sizes) and sizes.max() > LONGEST_RUN:
            n = -(-sizes // LONGEST_RUN)
            nth = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            starts = np.repeat(starts, n) + nth * LONGEST_RUN
            sizes = np.minimum(np.repeat(sizes, n) - nth * LONGEST_RUN, LONGEST_RUN)
        part = np.searchsorted(at, starts, "right") - 1
        out = m[starts], doc[part], place[part] + starts - at[part], sizes
        if digests:  # of the first and the last gram and the length
            ends = h[starts] * _MIX[2] ^ h[starts + sizes - 1 + window - GRAM] * _MIX[1] ^ sizes.astype(np.uint64) * _MIX[3]
            out = (*out, (ends >> np.uint64(56)).astype(np.uint8))
        yield (*out, starts, _window_hashes(h, window)) if hashes else out


def _bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (gram >> np.uint64(40)).astype(np.int64) % buckets


def two_stage_suffixes(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """Places of the needed suffixes of `text`, sorted by their first `depth` bytes.

    Suffixes smaller than their successors are sorted directly. Scanning the buckets of first bytes upwards, each suffix
    met puts its predecessor, if that is larger than it, next into the bucket of the predecessor's first byte.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=-1))  # 1: smaller than the successor; the last is larger than none
    known = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
    keep = needed.copy()
    # a larger suffix needs its successors up to the next smaller one
    reach = np.flatnonzero(needed & ~small)
    while len(reach):
        reach = reach[reach + 1 < n] + 1
        reach = reach[~keep[reach]]
        keep[reach] = True
        reach = reach[~small[reach]]
    direct = np.flatnonzero(keep & small)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    keys = [_words(padded, ">u8", k, n)[direct].astype(np.uint64) for k in range(0, depth, 8)]
    if depth % 8:
        keys[-1] >>= np.uint64(64 - 8 * (depth % 8))
    direct = direct[np.lexsort(keys[::-1])]
    larger = keep & ~small
    count_larger = np.bincount(text[larger], minlength=256)
    by_byte = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    filled: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and larger[n - 1]:
        filled[text[n - 1]].append(np.array([n - 1]))

    def induce(wave: np.ndarray) -> None:
        before = wave[wave > 0] - 1
        before = before[larger[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cut):
                filled[text[part[0]]].append(part)

    out = []
    for c in range(256):
        k = 0
        while k < len(filled[c]):  # grows while a byte repeats
            induce(filled[c][k])
            k += 1
        assert sum(map(len, filled[c])) == count_larger[c]
        out += filled[c]
        out.append(by_byte[c])
        induce(by_byte[c])
        filled[c] = []
    return np.concatenate(out)


def window_owners(strings: list[bytes], owner: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string, in order: the smallest owner of a string that holds the same window."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.array([len(s) for s in strings]).cumsum()
    starts_window = np.zeros(len(text), bool)
    first = np.concatenate(([0], ends[:-1]))
    counts = ends - first - window + 1
    at = np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts) + np.repeat(first, counts)
    starts_window[at] = True
    order = two_stage_suffixes(text, starts_window, window)
    order = order[starts_window[order]]
    padded = np.concatenate([text, np.zeros(window + 8, np.uint8)])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (*range(0, window - 8, 8), window - 8):  # adjacent common prefixes, as far as a window goes
        live = np.flatnonzero(same)
        w = _words(padded, "<u8", k, len(text))
        same[live] = w[order[live]] == w[order[live + 1]]
    run = np.concatenate(([0], np.cumsum(~same)))
    own = np.repeat(owner, counts)
    place = np.empty(len(text), np.int64)
    place[at] = np.arange(len(at))
    who = own[place[order]]
    low = np.minimum.reduceat(who, np.concatenate(([0], np.flatnonzero(~same) + 1)))
    out = np.empty(len(at), np.int64)
    out[place[order]] = low[run]
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint maximal spans (start, end), sorted; spans that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > far[:-1]))
    return np.stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(new))], 1)


def _blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw) if raw else raw


def _group_texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, text hashes and texts of a group's rows, in order of the ids."""
    ids, th = t["id"].to_numpy(), t["th"].to_numpy()
    order = np.lexsort((th, ids))
    col = t["text"]
    return ids[order], th[order], [col[k].as_py().encode("utf-8", "surrogatepass") for k in order.tolist()]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, group_bytes: int = 4 << 20, finish=None, schema: str | None = None, carry: list[str] | None = None, hot_groups: int = 64) -> DataFrame:
    """A row for each document, made by `finish(ids, texts, spans, rows)`: spans are the removed ones of each text, rows a
    table with the columns named in `carry`, as carry_0, carry_1 and so on.

    A byte is removed if a string of `window` bytes that covers it also starts in a document with a smaller id. A null text
    is empty. Rows with a null id come after all ids; rows that share an id never remove from each other.
    """
    if window < GRAM + 8:
        raise ValueError(f"window must be at least {GRAM + 8}")
    carried = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry or [])]
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carried)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group_bytes = min(max(group_bytes, total >> 13), max(group_bytes, 64 << 20))  # groups grow first, so that their rows to buckets stay large
    groups = max(1, -(-total // group_bytes))
    base = base.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), "id", F.xxhash64("text").alias("th"), "text", *(f"carry_{k}" for k in range(len(carried))))
    buckets, carry_names = groups, [f"carry_{k}" for k in range(len(carried))]

    def by_bucket(g: int, gram: np.ndarray, who: np.ndarray, digest: np.ndarray | None = None) -> pa.Table:
        """A row for each bucket: the group's distinct grams (or window hashes), and a tag of each: the largest digest of its
        records, and a last bit that is set if several documents hold it."""
        order = np.argsort(gram, kind="stable")
        gram, who = gram[order], who[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1])))
        many = (np.minimum.reduceat(who, new) != np.maximum.reduceat(who, new)).astype(np.uint8) if len(new) else np.zeros(0, np.uint8)
        tag = many if digest is None or not len(new) else many | (np.maximum.reduceat(digest[order], new) & np.uint8(0x3E))
        gram = gram[new]
        b = _bucket_of(gram, buckets)
        order = np.argsort(b, kind="stable")
        b, gram, tag = b[order], gram[order], tag[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(b)), bool), b[1:] != b[:-1])))
        rows = [(int(b[s]), _blob(gram[s:e], "<u8"), _blob(tag[s:e], "u1")) for s, e in zip(at, np.append(at[1:], len(b)))]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array([g] * len(rows), pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "g", "grams", "tags"])

    def grams(t: pa.Table) -> pa.Table:
        ids, _, texts = _group_texts(t)
        gram, who, digest = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for m, doc, _, _, told in records(texts, window, digests=True):
            gram.append(m)
            who.append(ids[doc])
            digest.append(told)
        return by_bucket(t["g"][0].as_py(), *(np.concatenate(x) for x in (gram, who, digest)))

    def answers(t: pa.Table, only_hot: bool) -> pa.Table:
        """To each group that asked: its grams that others hold, and which of them are hot; or the hot ones alone."""
        own = [np.frombuffer(x.as_py(), "<u8") for x in t["grams"]]
        tag = np.concatenate([np.frombuffer(x.as_py(), "u1") for x in t["tags"]])
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        s, digest = every[order], tag[order] >> np.uint8(1)
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        count = np.diff(np.append(new, len(s)))
        differ = np.ones(len(new), np.int64)
        for k in np.flatnonzero(count > hot_groups).tolist():
            differ[k] = len(np.unique(digest[new[k] : new[k] + count[k]]))
        n, hot = np.empty(len(s), np.int64), np.empty(len(s), bool)
        n[order], hot[order] = np.repeat(count, count), np.repeat((count > hot_groups) & (differ > min(12, hot_groups // 2)), count)
        cuts_at = np.cumsum([len(x) for x in own])[:-1]
        rows = [(g, _blob(x[h], "<u8"), _blob(w[h], "u1")) for g, x, h, w in zip(t["g"].to_pylist(), own, np.split(hot if only_hot else (n > 1) | (tag & np.uint8(1)).astype(bool), cuts_at), np.split(hot, cuts_at)) if h.any()]
        cols = list(zip(*rows)) or [[]] * 3
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["g", "grams", "hot"])

    def shared(t: pa.Table) -> pa.Table:
        return answers(t, False)

    def shared_hot(t: pa.Table) -> pa.Table:
        return answers(t, True)

    def told_grams(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Sorted grams that others hold, and which of them are hot."""
        gram = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in right["grams"]])
        hot = np.concatenate([np.frombuffer(x.as_py(), "u1") for x in right["hot"]]).astype(bool)
        order = np.argsort(gram)
        return gram[order], hot[order]

    def windows_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes) + np.repeat(starts, sizes)

    def hot_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        gram, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        wanted = np.zeros(0, np.uint64)
        if left.num_rows and right.num_rows:
            wanted, _ = told_grams(right)
        if len(wanted):
            ids, _, texts = _group_texts(left)
            for m, doc, _, sizes, starts, hashes in records(texts, window, hashes=True):
                hit = wanted[np.searchsorted(wanted, m).clip(max=len(wanted) - 1)] == m
                gram.append(hashes[windows_of(starts[hit], sizes[hit])])
                who.append(np.repeat(ids[doc[hit]], sizes[hit]))
        return by_bucket(left["g"][0].as_py() if left.num_rows else -1, np.concatenate(gram), np.concatenate(who))

    part_names = ["bucket", "kind", "g", "id", "th", "at", "n", "bytes"]
    part_schema = "bucket int, kind int, g int, id binary, th binary, at binary, n binary, bytes binary"

    def cut_records(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int32(),) * 3 + (pa.binary(),) * 5], names=part_names)
        g = left["g"][0].as_py()
        of_windows = right["windows"]
        wanted, hot = told_grams(right.filter(pa.compute.invert(of_windows)))
        common = right.filter(of_windows)
        common = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), "<u8") for x in common["grams"])]))
        ids, th, texts = _group_texts(left)
        first: dict[bytes, int] = {}
        send: dict[int, list] = {}
        covered: list[tuple[int, int, int, int]] = []
        for m, doc, place, size, starts, hashes in records(texts, window, hashes=True):
            at = np.searchsorted(wanted, m).clip(max=len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == m)
            warm = hot[at[hit]]
            keep = hit[~warm]
            own = [(m[keep], doc[keep], place[keep], size[keep])]
            keep = hit[warm]
            if len(keep) and len(common):  # runs of the windows of hot grams that several documents hold
                w = windows_of(starts[keep], size[keep])
                held = common[np.searchsorted(common, hashes[w]).clip(max=len(common) - 1)] == hashes[w]
                of = np.repeat(keep, size[keep])[held]
                w = w[held]
                new = np.flatnonzero(np.concatenate((np.ones(min(1, len(w)), bool), (of[1:] != of[:-1]) | (w[1:] != w[:-1] + 1))))
                k = of[new]
                own.append((m[k], doc[k], place[k] + w[new] - starts[k], np.diff(np.append(new, len(w)))))
            gram, k, s, n = (np.concatenate(x) for x in zip(*own))
            for b, k, s, n in zip(_bucket_of(gram, buckets).tolist(), k.tolist(), s.tolist(), n.tolist()):
                string = texts[k][s : s + n + window - 1]
                who = int(ids[k])
                if first.setdefault(string, who) == who:
                    send.setdefault(b, []).append((who, int(th[k]), s, n, string))
                else:
                    covered.append((who, int(th[k]), s, n))
        rows = []
        for b, got in send.items():
            i, h, s, n, x = zip(*got)
            rows.append((b, 1, g, *map(_packed, (_blob(i, "<i8"), _blob(h, "<i8"), _blob(s, "<i8"), _blob(n, "<u2"), b"".join(x)))))
        if covered:
            i, h, s, n = zip(*covered)
            rows.append((g % buckets, 0, g, *map(_packed, (_blob(i, "<i8"), _blob(h, "<i8"), _blob(s, "<i8"), _blob(n, "<u2"))), b""))
        cols = list(zip(*rows)) or [[]] * 8
        return pa.table([pa.array(c, x) for c, x in zip(cols, (pa.int32(),) * 3 + (pa.binary(),) * 5)], names=part_names)

    def spans_of_bucket(t: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes, bytes, bytes, bytes]] = []
        got = [{k: _unpacked(v) if isinstance(v, bytes) else v for k, v in r.items()} for r in t.to_pylist()]
        for r in got:
            if r["kind"] == 0:
                s = np.frombuffer(r["at"], "<i8")
                out.append((r["g"], r["id"], r["th"], r["at"], _blob(s + np.frombuffer(r["n"], "<u2") + window - 1, "<i8")))
        got = [r for r in got if r["kind"] == 1]
        if got:
            index: dict[bytes, int] = {}
            which, who, sizes = [], [], []
            for r in got:
                ids, n = np.frombuffer(r["id"], "<i8"), np.frombuffer(r["n"], "<u2").astype(np.int64)
                ends = np.cumsum(n + window - 1).tolist()
                raw = r["bytes"]
                which += [index.setdefault(raw[a:b], len(index)) for a, b in zip([0, *ends], ends)]
                who.append(ids)
                sizes.append(len(ids))
            which, who = np.array(which), np.concatenate(who)
            low = np.full(len(index), NO_ID)
            np.minimum.at(low, which, who)
            strings = list(index)
            owner = window_owners(strings, low, window)
            counts = np.array([len(s) - window + 1 for s in strings])
            first = counts.cumsum() - counts
            taken = owner < np.repeat(low, counts)  # windows that even a string's smallest document has from another
            edge = np.flatnonzero(np.diff(taken.astype(np.int8), prepend=0))
            inside = np.concatenate((edge, first))
            # spans of taken windows by string: runs of taken, cut where strings begin
            cuts_at = np.unique(inside)
            cuts_at = cuts_at[taken[cuts_at]]
            ends_at = np.unique(np.concatenate((np.flatnonzero(np.diff(taken.astype(np.int8), append=0) == -1) + 1, first[1:], [len(taken)])))
            stop = ends_at[np.searchsorted(ends_at, cuts_at, "right")]
            string_of = np.searchsorted(first, cuts_at, "right") - 1
            lo = np.searchsorted(string_of, np.arange(len(strings)))
            hi = np.searchsorted(string_of, np.arange(len(strings)), "right")
            rel_s, rel_e = cuts_at - first[string_of], stop - first[string_of]
            at = 0
            for r, n in zip(got, sizes):
                w, i = which[at : at + n], who[at : at + n]
                at += n
                h, s = np.frombuffer(r["th"], "<i8"), np.frombuffer(r["at"], "<i8")
                full = i > low[w]
                part = np.flatnonzero(~full & (hi[w] > lo[w]))
                reps = hi[w[part]] - lo[w[part]]
                src = np.repeat(part, reps)
                k = np.arange(reps.sum()) - np.repeat(reps.cumsum() - reps, reps) + np.repeat(lo[w[part]], reps)
                a = np.concatenate((s[full], s[src] + rel_s[k]))
                e = np.concatenate((s[full] + counts[w[full]] + window - 1, s[src] + rel_e[k] + window - 1))
                if len(a):
                    out.append((r["g"], _blob(np.concatenate((i[full], i[src])), "<i8"), _blob(np.concatenate((h[full], h[src])), "<i8"), _blob(a, "<i8"), _blob(e, "<i8")))
        cols = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, x) for c, x in zip(cols, (pa.int32(),) + (pa.binary(),) * 4)], names=["g", "id", "th", "start", "end"])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("id", "ascending"), ("th", "ascending")])
        ids, th, texts = _group_texts(left)
        found: dict[tuple[int, int], np.ndarray] = {}
        if right.num_rows:
            i, h, s, e = (np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in right[c]]) for c in ("id", "th", "start", "end"))
            order = np.lexsort((h, i))
            i, h, both = i[order], h[order], np.stack([s[order], e[order]], 1)
            at = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (h[1:] != h[:-1]))))
            for a, b in zip(at, np.append(at[1:], len(i))):
                found[int(i[a]), int(h[a])] = merged(both[a:b])
        none = np.zeros((0, 2), np.int64)
        return finish([None if x == NO_ID else x for x in ids.tolist()], texts, [found.get(k, none) for k in zip(ids.tolist(), th.tolist())], left.select(carry_names))

    asked, answer = "bucket int, g int, grams binary, tags binary", "g int, grams binary, hot binary"
    by_gram = base.groupBy("g").applyInArrow(grams, asked).groupBy("bucket")
    told = by_gram.applyInArrow(shared, answer).withColumn("windows", F.lit(False))
    told_hot = by_gram.applyInArrow(shared_hot, answer)
    hot = base.groupBy("g").cogroup(told_hot.groupBy("g")).applyInArrow(hot_windows, asked).groupBy("bucket").applyInArrow(shared, answer).withColumn("windows", F.lit(True))
    sent = base.groupBy("g").cogroup(told.unionByName(hot).groupBy("g")).applyInArrow(cut_records, part_schema)
    spans = sent.groupBy("bucket").applyInArrow(spans_of_bucket, "g int, id binary, th binary, start binary, end binary")
    return base.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(apply, schema)


def keep_bytes(text: bytes, spans: np.ndarray) -> bytes:
    parts, at = [], 0
    for s, e in spans.tolist():
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    return b"".join(parts)


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to the characters they cover whole, so that what is left is valid UTF-8."""
    out = []
    for s, e in spans.tolist():
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return np.array(out, np.int64).reshape(-1, 2)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, group_bytes: int = 4 << 20) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""

    def finish(ids: list, texts: list[bytes], spans: list[np.ndarray], _) -> pa.Table:
        removed = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
        sha = [hashlib.sha256(keep_bytes(t, s)).hexdigest() for t, s in zip(texts, spans)]
        cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string())]
        return pa.table(cols, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs, id_col, text_col, window, group_bytes, finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Per row: id, the text without the removed spans (only characters that are covered whole go), the spans in bytes, and the columns to carry."""
    carry = carry or []

    def finish(ids: list, texts: list[bytes], spans: list[np.ndarray], rows: pa.Table) -> pa.Table:
        whole = [whole_characters(t, s) for t, s in zip(texts, spans)]
        kept = [keep_bytes(t, s).decode("utf-8", "surrogatepass") for t, s in zip(texts, whole)]
        pairs = [[{"start": a, "end": b} for a, b in s.tolist()] for s in spans]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(pairs, kind), *rows.columns], names=["id", "kept_text", "spans", *(f"carry_{k}" for k in range(len(carry)))])

    kinds = dict(docs.dtypes)
    schema = "id long, kept_text string, spans array<struct<start:long,end:long>>" + "".join(f", carry_{k} {kinds[c]}" for k, c in enumerate(carry))
    found = removed_spans(docs, id_col, text_col, window, finish=finish, schema=schema, carry=carry)
    return found.withColumnsRenamed({f"carry_{k}": c for k, c in enumerate(carry)})
