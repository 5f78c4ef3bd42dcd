"""Suffix-array dedup: a depth-limited radix sort of suffixes finds every repeated window of ``LENGTH`` bytes.

Suffixes are ordered only through the window's length, by most-significant-digit passes that leave out what has become
alone. So that not every suffix is moved, suffixes are ordered through the anchor of their window: the ``KMER`` bytes in
it whose mixed hash is smallest (the leftmost on ties). Equal windows have their anchor at the same place, and a run of
windows shares one.

- Pass 1, digit: a fingerprint of the anchor. Each pack of batches of documents sends its distinct fingerprints with their
  counts, bucket by bucket; those that stand alone are done. Packs get back the fingerprints that occur more than once,
  and which of them are hot, that is occur more than ``HOT`` times.
- Pass 2, digits: the anchor's bytes, eight at a time, in a bucket's suffixes of all packs; then, for each place of
  the anchor in the window, the window's other bytes. Groups that are equal through all digits are the repeated windows;
  a window goes if the group holds a smaller id. Around a hot anchor each window is a suffix of its own and is dealt by one
  more digit, a checksum of its bytes, so that one short line in all documents, each time in other surroundings, is spread.

Equal texts around an anchor are sent once for each batch, with the batch's smallest id, so that a passage in a third of
all documents is a row for each batch and not for each document. Batches are stored, bucketed by their pack, in the
shared folder: only fingerprints, suffixes and answers are shuffled, texts aren't.

Defined cases: matches never cross documents; null ids count as larger than all others and null or empty texts have no
windows; rows of equal id don't remove each other's bytes; an empty table gives an empty result; texts are whole, of any
length; further columns are ignored but those asked to be carried along, which come in a struct of their own, so that their
names can't clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import noted
from .common import given_back, lean, materialize, shared_dir

LENGTH, KMER = 50, 32
#: Bytes of text in a batch, batches in a pack, and bytes of text that a bucket of pass 1 and of pass 2 has the anchors of.
BATCH, PACK, BUCKET1, BUCKET = 1 << 20, 6, 16 << 20, 4 << 20
#: Bytes of text that anchors are sought in at once, and how often an anchor occurs until its windows are dealt one by one.
PIECE, HOT = 1 << 19, 20_000
_LAST = 2**63 - 1
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _hashes(text: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the KMER bytes from each place on (of no use at the last places)."""
    h = text.astype(np.uint64) + np.uint64(1)
    size, power = 1, _BASE
    while size < KMER:
        new = h * np.uint64(power)
        new[:-size] += h[size:]
        h, size, power = new, size * 2, power * power & _MASK
    return _mixed(h)


def _runs(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: for each run of windows with one anchor its first and last window, the anchor, its hash and the document."""
    ends = np.cumsum(sizes)
    width = LENGTH - KMER + 1
    windows = np.maximum(sizes - LENGTH + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = _hashes(text)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low[:-size] = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        rest = width - size
        low[:-rest] = np.minimum(low[:-rest], low[rest:])
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), windows)
    first = np.arange(len(doc), dtype=np.int32)
    first += np.repeat((ends - sizes - np.cumsum(windows) + windows).astype(np.int32), windows)
    anchor = low.astype(np.uint32)[first]  # the lower half is the place
    del low
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    stop = np.r_[new[1:], len(doc)] - 1
    place = anchor[new].astype(np.int64)
    return first[new].astype(np.int64), first[stop].astype(np.int64), place, h[place], doc[new].astype(np.int64)


def runs(text: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The same, PIECE bytes at a time; a document longer than that is gone through in parts that overlap by a window."""
    ends, found, at = np.cumsum(sizes), [_runs(text[:0], sizes[:0])], 0
    while at < len(sizes):
        start = int(ends[at] - sizes[at])
        if sizes[at] > PIECE:
            stop, steps = at + 1, [(start + k, min(start + k + PIECE + LENGTH - 1, int(ends[at]))) for k in range(0, int(sizes[at]) - LENGTH + 1, PIECE)]
        else:
            stop = max(at + 1, int(np.searchsorted(ends, start + PIECE, "right")))
            steps = [(start, int(ends[stop - 1]))]
        for a, b in steps:
            own = sizes[at:stop] if stop - at > 1 else np.array([b - a])
            lo, hi, anchor, prints, doc = _runs(text[a:b], own)
            found.append((lo + a, hi + a, anchor + a, prints, doc + at))
        at = stop
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, sizes and sort keys of a batch's documents."""
    sizes = np.asarray(row["sizes"], dtype=np.int64)
    text = np.frombuffer(pa.decompress(row["texts"], int(sizes.sum()), "zstd", asbytes=True), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
    return text, sizes, np.asarray(row["keys"], dtype=np.int64)


def _packed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Batches of whole documents: (pack, batch, ids, keys, sizes, texts and carried columns), bucketed by pack."""
    spark = docs.sparkSession
    types = {c: docs.schema[c].dataType.simpleString() for c in carry}
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("__text"), *(F.col(c) for c in carry))
    schema = ", ".join(["pack long", "batch int", "ids array<long>", "keys array<long>", "sizes array<int>", "texts binary", "n_bytes long", *(f"`carry_{k}` array<{types[c]}>" for k, c in enumerate(carry))])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = batch["__text"].map(len).to_numpy()
            part = (np.cumsum(sizes) - sizes) // BATCH
            for k in np.unique(part):
                own = batch[part == k]
                whole = b"".join(own["__text"])
                ids = [None if pd.isna(i) else int(i) for i in own["__id"]]
                row = {"pack": base + number // PACK, "batch": number % PACK, "ids": ids, "keys": [_LAST if i is None else i for i in ids], "sizes": sizes[part == k].astype(np.int32), "texts": pa.compress(whole, "zstd", asbytes=True), "n_bytes": len(whole)}
                yield pd.DataFrame([row | {f"carry_{j}": [None if v is None or v != v else v for v in own[c].astype(object)] for j, c in enumerate(carry)}])
                number += 1

    name = f"batches_{uuid.uuid4().hex}"
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(12, min(100_000, total // (BATCH * PACK)))
    noted(name, f"{shared_dir(spark)}/{name}")
    rows.mapInPandas(lean(pack), schema).write.bucketBy(n, "pack").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def _fingerprints(batches: DataFrame, buckets: int) -> DataFrame:
    """Pass 1: (pack, bucket, found, hot) with the fingerprints of a pack that occur more than once, bucket by bucket."""

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        prints = [runs(*_unpacked(row)[:2])[3] for _, row in frame.iterrows()]
        value, times = np.unique(np.concatenate(prints), return_counts=True)
        bucket = (value % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        value, times = (value >> np.uint64(32)).astype(np.uint32)[order], np.minimum(times, 255).astype(np.uint8)[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        given_back()
        part = lambda v: [v[edges[b] : edges[b + 1]].tobytes() for b in full]
        return pd.DataFrame({"bucket": full.astype(np.int32), "pack": frame["pack"].iat[0], "prints": part(value), "times": part(times)})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(frame["prints"]), np.uint32)
        _, at = np.unique(own, return_inverse=True)
        total = np.bincount(at, weights=np.frombuffer(b"".join(frame["times"]), np.uint8))[at]
        ends = np.cumsum(frame["times"].map(len))
        rows = []
        for pack, bucket, size, end in zip(frame["pack"], frame["bucket"], frame["times"].map(len), ends, strict=True):
            n, v = total[end - size : end], own[end - size : end]
            if (n > 1).any():
                rows.append((pack, bucket, v[n > 1].tobytes(), (n[n > 1] > HOT).tobytes()))
        return pd.DataFrame(rows, columns=["pack", "bucket", "found", "hot"])

    sent = batches.select("pack", "keys", "sizes", "texts").groupBy("pack").applyInPandas(send, "bucket int, pack long, prints binary, times binary")
    return sent.groupBy("bucket").applyInPandas(meet, "pack long, bucket int, found binary, hot binary")


SENT = "bucket int, pack long, at binary, sizes binary, anchors binary, keys binary, texts binary, raw int"


def _asked(prints: np.ndarray, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have a fingerprint that occurs more than once, and which of these are hot."""
    digit = lambda bucket, value: (bucket.astype(np.uint64) << np.uint64(32)) | value.astype(np.uint64)
    found = [digit(np.full(len(f) // 4, b), np.frombuffer(f, np.uint32)) for b, f in zip(answers["bucket"], answers["found"], strict=True)]
    known = np.concatenate([*found, np.zeros(0, np.uint64)])
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(known)
    known, hot = known[order], np.frombuffer(b"".join(answers["hot"]), bool)[order]
    own = digit(prints % np.uint64(buckets), prints >> np.uint64(32))
    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
    picked = np.flatnonzero(known[place] == own)
    return picked, hot[place[picked]]


def _suffixes(batches: DataFrame, met: DataFrame, buckets1: int, buckets: int) -> DataFrame:
    """Pass 2, sending side: the distinct texts around anchors that occur more than once; ``at`` holds the batch and the place."""

    def send(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts, rest = defaultdict(list), []
        for _, row in own.iterrows():
            text, sizes, keys = _unpacked(row)
            lo, hi, anchor, prints, doc = runs(text, sizes)
            picked, hot = _asked(prints, answers, buckets1)
            if not len(picked):
                continue
            lo, hi, anchor, prints, owner = lo[picked], hi[picked], anchor[picked], prints[picked], keys[doc[picked]]
            # around a hot anchor each window goes by itself
            times = np.where(hot, hi - lo + 1, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            lo, hi, anchor, prints, owner, hot = (np.repeat(c, times) for c in (lo, hi, anchor, prints, owner, hot))
            lo = lo + step
            hi = np.where(hot, lo, hi)
            whole, starts, stops, who = text.tobytes(), lo.tolist(), (hi + LENGTH).tolist(), owner.tolist()
            least: dict[bytes, tuple[int, int]] = {}
            for k, (a, b, key) in enumerate(zip(starts, stops, who, strict=True)):
                t = whole[a:b]
                if t not in least or key < least[t][0]:
                    least[t] = (key, k)
            gone, same, first = [], [], []  # runs that a smaller id of the batch has; those like a sent one of their own id
            for k, (a, b, key) in enumerate(zip(starts, stops, who, strict=True)):
                known, sent = least[whole[a:b]]
                if key > known:
                    gone.append(k)
                elif k != sent:
                    same.append(k)
                    first.append(starts[sent])
            sent = np.array([k for _, k in least.values()], dtype=np.int64)
            del least
            bucket = (prints[sent] % np.uint64(buckets)).astype(np.int64)
            for n in np.flatnonzero(hot[sent]).tolist():
                bucket[n] = zlib.crc32(whole[starts[sent[n]] : stops[sent[n]]]) % buckets
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            base = np.int64(row["batch"]) << 32
            at, size = lo + base, hi - lo
            for b, k in _parts(sent, bucket):
                parts[b].append((at[k], (size[k] + LENGTH).astype(np.uint8), (anchor[k] - lo[k]).astype(np.uint8), owner[k], b"".join(whole[starts[j] : stops[j]] for j in k.tolist())))
            # what needs no further digit goes along: (place, windows) of runs that go, (place, place of the one sent) of like ones
            g = np.array(gone, dtype=np.int64)
            rest.append((at[g], size[g].astype(np.uint8), at[np.array(same, dtype=np.int64)], np.array(first, dtype=np.int64) + base, b""))
        out = {c.split(" ")[0]: [] for c in SENT.split(", ")}
        pack = int(own["pack"].iat[0]) if len(own) else 0
        for bucket, some in [*parts.items(), (-1 - pack % 1021, rest)]:
            if some:
                texts = b"".join(x[4] for x in some)
                packed = pa.compress(texts, "zstd", asbytes=True) if texts else b""
                values = [np.concatenate([x[k] for x in some]).tobytes() for k in range(4)]
                for name, value in zip(out, (bucket, pack, *values, packed, len(texts)), strict=True):
                    out[name].append(value)
        given_back()
        return pd.DataFrame(out)

    left = batches.select("pack", "batch", "keys", "sizes", "texts").groupBy("pack")
    return left.cogroup(met.groupBy("pack")).applyInPandas(send, SENT)


def _parts(items: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(items) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), items[a:b]


ANSWERS = "pack long, at binary, windows binary, like binary, first binary"


def _groups(order: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
    """Group numbers, in sorted order, of items that are equal in all digits."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for d in digits:
        s = d[order]
        new[1:] |= s[1:] != s[:-1]
    return np.cumsum(new) - 1


def resolve(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each suffix a bit for each of its windows, set if an equal window has a smaller key."""
    n = len(starts)
    mask = np.zeros(n, dtype=np.uint32)
    width = LENGTH - KMER
    kmer = np.ascontiguousarray(text[(starts + anchors)[:, None] + np.arange(KMER)]).view(">u8").astype(np.uint64)
    alive = np.arange(n)
    group = np.zeros(n, dtype=np.int64)
    for d in range(kmer.shape[1]):  # most significant digit first; what is alone is done
        order = np.lexsort((kmer[alive, d], group))
        g = _groups(order, [group, kmer[alive, d]])
        size = np.bincount(g)
        keep = size[g] > 1
        alive, group = alive[order][keep], g[keep]
    for o in range(width + 1):  # bytes of the window before its anchor
        at = anchors[alive] - o
        own = np.flatnonzero((at >= 0) & (at + LENGTH <= sizes[alive]))
        if len(own) < 2:
            continue
        i, s = alive[own], at[own]
        place = np.r_[np.arange(o), np.arange(o + KMER, LENGTH)]
        rest = np.zeros((len(i), 24), dtype=np.uint8)
        rest[:, :width] = text[(starts[i] + s)[:, None] + place]
        digits = [*rest.view(">u8").astype(np.uint64).T[::-1], group[own]]
        order = np.lexsort(digits)
        g = _groups(order, digits)
        key = keys[i][order]
        least = np.minimum.reduceat(key, np.flatnonzero(np.r_[True, g[1:] != g[:-1]]))
        less = least[g] < key
        mask[i[order][less]] |= np.uint32(1) << s[order][less].astype(np.uint32)
    return mask


def _answers(sent: DataFrame) -> DataFrame:
    """Pass 2: for each batch the runs (place) and windows (bits) that a smaller id holds as well."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iat[0] < 0:
            windows = [((np.uint32(2) << np.frombuffer(s, np.uint8).astype(np.uint32)) - np.uint32(1)).tobytes() for s in frame["sizes"]]
            return pd.DataFrame({"pack": frame["pack"], "at": frame["at"], "windows": windows, "like": frame["anchors"], "first": frame["keys"]})
        text = np.frombuffer(b"".join(pa.decompress(t, n, "zstd", asbytes=True) for t, n in zip(frame["texts"], frame["raw"], strict=True)), np.uint8)
        whole = lambda c, kind: np.frombuffer(b"".join(frame[c]), kind)
        sizes, at = whole("sizes", np.uint8).astype(np.int64), whole("at", np.int64)
        mask = resolve(text, np.cumsum(sizes) - sizes, sizes, whole("anchors", np.uint8).astype(np.int64), whole("keys", np.int64))
        count = frame["sizes"].map(len).to_numpy()
        out = []
        for pack, end, n in zip(frame["pack"], np.cumsum(count), count, strict=True):
            own = slice(end - n, end)
            hit = mask[own] > 0
            if hit.any():
                out.append((pack, at[own][hit].tobytes(), mask[own][hit].tobytes(), b"", b""))
        given_back()
        return pd.DataFrame(out, columns=["pack", "at", "windows", "like", "first"])

    return sent.groupBy("bucket").applyInPandas(meet, ANSWERS)


def repeats(docs: DataFrame, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end) of the bytes removed, kept (the bytes left) of every row of ``docs``; its columns ``carry`` as a struct ``carried``.

    With ``as_text`` what is kept comes as text: of characters that a removal has cut the bytes left go, too.
    """
    carry = carry or []
    batches = _packed(docs, carry)
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    buckets1, buckets = max(64, total // BUCKET1), max(64, total // BUCKET)
    answers = materialize(_answers(_suffixes(batches, _fingerprints(batches, buckets1), buckets1, buckets)), "repeats")
    types = {c: docs.schema[c].dataType.simpleString() for c in carry}

    def remove(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        whole = lambda c, kind: np.frombuffer(b"".join(found[c]), kind)
        at, windows, like, first = whole("at", np.int64), whole("windows", np.uint32), whole("like", np.int64), whole("first", np.int64)
        if len(like) and len(at):
            order = np.argsort(at)
            place = np.minimum(np.searchsorted(at[order], first), len(at) - 1)
            hit = at[order][place] == first
            at, windows = np.r_[at, like[hit]], np.r_[windows, windows[order][place[hit]]]
        out = []
        for _, row in own.iterrows():
            text, sizes, _ = _unpacked(row)
            here = (at >> 32) == row["batch"]
            places, bits = at[here] & 0xFFFFFFFF, windows[here]
            change = np.zeros(len(text) + 1, dtype=np.int32)
            for s in range(LENGTH - KMER + 1):
                start = places[(bits >> np.uint32(s)) & np.uint32(1) > 0] + s
                np.add.at(change, start, 1)
                np.add.at(change, start + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            ends = np.cumsum(sizes)
            for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                part = gone[a:b]
                edges = np.flatnonzero(np.diff(np.r_[False, part, False].astype(np.int8))).tolist() if part.any() else []
                left = [text[a + x : a + y].tobytes() for x, y in zip([0, *edges[1::2]], [*edges[0::2], b - a], strict=True)]
                kept = "".join(t.decode("utf-8", "ignore") for t in left) if as_text else b"".join(left)
                spans = [{"start": x, "end": y} for x, y in zip(edges[0::2], edges[1::2], strict=True)]
                out.append((row["ids"][k], b - a, int(part.sum()), spans, kept, *(row[f"carry_{j}"][k] for j in range(len(carry)))))
        given_back()
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept", *(f"carry_{j}" for j in range(len(carry)))], dtype=object)

    columns = ["doc_id long", "n_bytes long", "n_removed long", "spans array<struct<start:long,end:long>>", f"kept {'string' if as_text else 'binary'}"]
    schema = ", ".join([*columns, *(f"carry_{j} {types[c]}" for j, c in enumerate(carry))])
    out = batches.drop("n_bytes").groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(remove, schema)
    carried = [F.struct(*(F.col(f"carry_{j}").alias(c) for j, c in enumerate(carry))).alias("carried")] if carry else []
    return out.select("doc_id", "n_bytes", "n_removed", "spans", "kept", *carried)
