"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import _pack, _unpack
from leafmill.llm.scratch import give_back, partitions, shared_dir

LENGTH, GRAM, HALF = 50, 16, 32
CHUNK_BITS = 16
BLOCK_BYTES = 4_000_000
#: Anchors are looked for in pieces of about so many bytes of whole documents, which bounds the memory of a block.
PIECE_BYTES = 1 << 18
#: Contexts of a part are dealt by their anchors to groups of about so many bytes, of FINE at most, sorted one by one.
GROUP_BYTES, FINE = 750_000, 65536
#: A suffix array holds so many bytes; several are merged by binary search, so many strings at a time.
SHARD_BYTES, MERGE_STRINGS = 2_000_000, 300_000
#: So many blocks, at most, for each part in which contexts meet.
PART_BLOCKS = 5
#: Runs are written back so many at a time.
STRIKE_RUNS = 1 << 14
NO_ID = np.iinfo(np.int64).max


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at each place."""
    x, power, width = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        x = x[:-width] * np.uint64(power) + x[width:]
        power, width = power * power % 2**64, 2 * width
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place where LENGTH bytes start, the anchor's place and hash. In chunks that fit a processor's cache."""
    n = len(data) - LENGTH + 1
    place, found = np.empty(n, np.int64), np.empty(n, np.uint64)
    bits = np.uint64(CHUNK_BITS + 1)
    for at in range(0, n, 1 << CHUNK_BITS):
        hashes = _gram_hashes(data[at : min(at + (1 << CHUNK_BITS), n) + LENGTH - 1])
        least = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= LENGTH - GRAM + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := LENGTH - GRAM + 1 - width:
            least = np.minimum(least[:-rest], least[rest:])
        own = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        place[at : at + len(own)], found[at : at + len(own)] = own + at, hashes[own]
    return place, found


def runs(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, first, last) of each run of places where LENGTH bytes start that have their anchor in common.

    A string's anchor is the GRAM-byte piece in it with the least hash, the leftmost of equals. It depends on the
    string alone, so equal strings have equal anchors at equal places, wherever they are.
    """
    none = (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    if len(data) < LENGTH:
        return none
    anchor, hashes = _anchors(data)
    ends = np.cumsum(lens)
    inside = np.ones(len(data) + LENGTH, bool)  # places whose LENGTH bytes are of one document
    for k in range(1, LENGTH):
        inside[ends - k] = False
    short = np.nonzero(lens < LENGTH)[0]
    for d in short:
        inside[ends[d] - lens[d] : ends[d]] = False
    starts = np.nonzero(inside[: len(anchor)])[0]
    if not len(starts):
        return none
    anchor = anchor[starts]
    cut = np.nonzero(np.diff(anchor))[0]
    first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    return hashes[first] >> np.uint64(16), np.searchsorted(ends, first, side="right"), first, last


def _ranks(data: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the places by the depth bytes that start there, by Larsson and Sadakane's refinement: each pass
    doubles the sorted length and sorts only the groups that are not yet single. rest: how many bytes of its context
    each place has; only places with depth bytes get their rank."""
    n = len(data)
    word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
    at = np.nonzero(rest >= 8)[0]
    word = word[at]
    by = np.argsort(word)
    at, word = at[by], word[by]
    rank = np.zeros(n, np.int64)
    opens = np.concatenate([[True], word[1:] != word[:-1]])
    rank[at] = np.nonzero(opens)[0][np.cumsum(opens) - 1]
    h = 8
    while h < depth:
        single = opens & np.concatenate([opens[1:], [True]])
        at = at[~single & (rest[at] >= 2 * h)]
        if not len(at):
            break
        key = rank[at] * (n + 1) + rank[at + h]
        by = np.argsort(key)
        at, key = at[by], key[by]
        opens = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[at]
        begins = np.concatenate([[True], old[1:] != old[:-1]])
        # a group's parts are told apart by their offsets in it, which stay below its size
        run, group = np.nonzero(opens)[0][np.cumsum(opens) - 1], np.nonzero(begins)[0][np.cumsum(begins) - 1]
        rank[at] = old + run - group
        h *= 2
    return rank


def _common(data: np.ndarray, at: np.ndarray, order: np.ndarray, n_strings: np.ndarray) -> np.ndarray:
    """Kasai's scan: for each place of the suffix array order (of strings, which start at places at), how many of its
    LENGTH bytes a string has in common with the one before it.

    The scan goes through all contexts in step, one place of each at a time: what a string has in common with its
    neighbour, the next string has but one byte less, if the string after the neighbour comes before it in the array.
    """
    n = len(at)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lasts = np.zeros(n, bool)  # the last string of its context
    ends = np.cumsum(n_strings)
    lasts[ends[n_strings > 0] - 1] = True
    first = ends - n_strings
    common, held = np.zeros(n, np.int64), np.zeros(len(n_strings), np.int64)
    lanes = np.nonzero(n_strings > 0)[0]
    step = 0
    while len(lanes):
        i = first[lanes] + step
        j = before[i]
        h = np.zeros(len(lanes), np.int64)
        if step:
            old = before[i - 1]
            safe = (old >= 0) & ~lasts[old]
            follows = np.where(safe, old + 1, 0)
            carried = safe & (place[follows] < place[i])
            h[carried] = np.maximum(held[lanes[carried]] - 1, 0)
        open_ = np.nonzero(j >= 0)[0]
        while len(open_):
            open_ = open_[h[open_] < LENGTH]
            open_ = open_[data[at[i[open_]] + h[open_]] == data[at[j[open_]] + h[open_]]]
            h[open_] += 1
        common[place[i]] = h
        held[lanes] = h
        step += 1
        lanes = lanes[n_strings[lanes] > step]
    return common


def _shard(contexts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of one shard's contexts: each string's class, and for each class, in ascending order of strings, the
    smallest id of its contexts and a place in the joined bytes; and those bytes.

    The shard's suffix array orders its strings by the ranks of their first 32 bytes and of those from 18 on, which
    cover LENGTH; neighbours in it with LENGTH bytes in common fall into one class.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lens = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(lens)
    rank = _ranks(data, np.repeat(ends, lens) - np.arange(len(data)), HALF)
    n_strings = lens - LENGTH + 1
    of = np.repeat(np.arange(len(lens)), n_strings)
    at = np.arange(n_strings.sum()) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings) + np.repeat(ends - lens, n_strings)
    order = np.argsort(rank[at] * (len(data) + 1) + rank[at + LENGTH - HALF])
    opens = _common(data, at, order, n_strings) < LENGTH
    kind = np.empty(len(order), np.int32)
    kind[order] = np.cumsum(opens) - 1
    return kind, np.minimum.reduceat(ids[of[order]], np.nonzero(opens)[0]), at[order[opens]].astype(np.int32), data


def _strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The strings at places of data, with a last byte that keeps a zero at the end."""
    out = np.ones((len(at), LENGTH + 1), np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
    return out.reshape(-1).view(f"S{LENGTH + 1}")


def _merge(done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], strings: int = MERGE_STRINGS) -> None:
    """Give each class of each shard the smallest id that any shard has for its string.

    The shards' ordered strings are cut at the same strings into ranges of about so many strings; only one range is
    spelt out at a time, in which each shard's strings are looked up by binary search in those of the shards before.
    """
    ranges = -(-sum(len(at) for _, _, at, _ in done) // strings)
    step = max(1, strings // 64)
    sample = np.sort(np.concatenate([_strings(data, at[::step]) for _, _, at, data in done]))
    splits = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges])
    cuts = [np.concatenate([[0], np.searchsorted(_strings(data, at), splits), [len(at)]]) for _, _, at, data in done]
    for r in range(len(splits) + 1):
        known, low = np.empty(0, f"S{LENGTH + 1}"), np.empty(0, np.int64)
        for (_, least, at, data), cut in zip(done, cuts):
            own, mine = _strings(data, at[cut[r] : cut[r + 1]]), least[cut[r] : cut[r + 1]]
            place = np.searchsorted(known, own)
            same = np.zeros(len(own), bool)
            if len(known):
                same = known[np.minimum(place, len(known) - 1)] == own
            low[place[same]] = np.minimum(low[place[same]], mine[same])
            known, low = np.insert(known, place[~same], own[~same]), np.insert(low, place[~same], mine[~same])
        for (_, least, at, data), cut in zip(done, cuts):
            least[cut[r] : cut[r + 1]] = low[np.searchsorted(known, _strings(data, at[cut[r] : cut[r + 1]]))]


def least_ids(contexts: list[bytes], ids: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For each string of each context in turn, the smallest id of any context that has it: a suffix array for each
    shard of shard_bytes, whose strings are looked up in those of the other shards by binary search."""
    cuts, size = [0], 0
    for k, c in enumerate(contexts):
        if size + len(c) > shard_bytes and k > cuts[-1]:
            cuts.append(k)
            size = 0
        size += len(c)
    cuts.append(len(contexts))
    done = [_shard(contexts[a:b], ids[a:b]) for a, b in zip(cuts, cuts[1:])]
    if len(done) > 1:
        _merge(done)
    return np.concatenate([least[kind] for kind, least, _, _ in done])


class _Block:
    """The bytes of some documents."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = b"".join(texts)

    def payload(self) -> bytes:
        return _pack(self.ids, self.lens, self.data)

    @classmethod
    def read(cls, payload: bytes) -> _Block:
        self = cls.__new__(cls)
        ids, lens, self.data = _unpack(payload)
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        return self

    def runs(self):
        """The runs of all documents, found in pieces of whole documents."""
        ends = np.cumsum(self.lens)
        data, out, doc, begin = np.frombuffer(self.data, np.uint8), [], 0, 0
        while doc < len(ends):
            stop = max(doc + 1, int(np.searchsorted(ends, begin + PIECE_BYTES, side="right")))
            hashes, docs, first, last = runs(data[begin : ends[stop - 1]], self.lens[doc:stop])
            out.append((hashes, docs + doc, first + begin, last + begin))
            doc, begin = stop, int(ends[stop - 1])
        return tuple(map(np.concatenate, zip(*out)))

    def shared(self, payloads) -> tuple[tuple[np.ndarray, ...], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The runs with an anchor that another document has; their distinct contexts with their anchors and
        smallest ids; the context of each run."""
        hashes, doc, first, last = self.runs()
        known = np.sort(np.concatenate([np.frombuffer(_unpack(p)[0], np.uint64) for p in payloads] or [np.empty(0, np.uint64)]))
        if len(known):
            held = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        else:
            held = np.zeros(len(hashes), bool)
        hashes, doc, first, last = hashes[held], doc[held], first[held], last[held]
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(self.data[a : b + LENGTH], len(number)) for a, b in zip(first.tolist(), last.tolist())), np.int64, len(first))
        least = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(least, of, self.ids[doc])
        anchors = np.zeros(len(number), np.uint64)
        anchors[of] = hashes
        return (doc, first, last), list(number), anchors, least, of


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): the byte spans of each text that go, and the bytes that stay.

    All suffixes of all shards can't meet, so strings meet by their anchors (see runs). Documents are cut into
    blocks. Anchors that occur in one document only are dropped; for the others, each block sends one copy of each
    distinct context of an anchor to the anchor's part; parts grow in number with the blocks, not in size. A part deals
    its contexts by their anchors to groups of bounded size. For each it builds the suffix array of each shard of
    shard_bytes bytes, finds by the common prefixes of neighbours which strings are equal, and merges the shards, of
    which only a group of one frequent anchor has several, by binary search. One bit for each string goes back to the
    blocks. No step drops a repeated string, and a passage that a third of all documents share is sent once by each block.

    A null text counts as empty. A null id is larger than all others; rows of one id don't remove from each other.
    Strings never cross documents; they are judged on the input. Ids are integers.
    """
    spark = docs.sparkSession
    parts = parts or 2 * partitions(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def rows(ids, texts):
            block = _Block(ids, texts)
            hashes, doc, _, _ = block.runs()
            order = np.argsort(hashes)
            h, i = hashes[order], block.ids[doc][order]
            opens = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
            at = np.nonzero(opens)[0]
            twice = np.minimum.reduceat(i, at) != np.maximum.reduceat(i, at) if len(at) else np.empty(0, bool)
            h = h[at]
            part = (h % np.uint64(parts)).astype(np.int64)
            out = [(number, "docs", -1, block.payload())]
            for p in np.unique(part):
                mine = part == p
                out.append((number, "anchors", int(p), _pack(np.diff(h[mine], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T, np.packbits(twice[mine]))))
            return pd.DataFrame(out, columns=["block", "kind", "part", "payload"])

        ids, texts, size = [], [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                raw = (text or "").encode("utf-8")
                if texts and size + len(raw) > block_bytes:
                    yield rows(ids, texts)
                    give_back()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(raw)
                size += len(raw)
        if texts:
            yield rows(ids, texts)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found, twice = [], []
        for payload in pdf["payload"]:
            planes, flags = _unpack(payload)
            h = np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)
            found.append(h)
            twice.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(h)).astype(bool))
        every = np.concatenate(found)
        kinds, kind, n = np.unique(every, return_inverse=True, return_counts=True)
        many = n > 1
        many[kind[np.concatenate(twice)]] = True
        del every, kinds
        cuts = np.cumsum(list(map(len, found)))[:-1]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "payload": [_pack(h[many[k]]) for h, k in zip(found, np.split(kind, cuts))]})

    def places(anchors: np.ndarray):
        """(part, places) of the anchors by the parts in which their contexts meet."""
        part = (anchors % np.uint64(n_sorts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cuts = np.nonzero(np.diff(part[by], prepend=-1))[0]
        return [(int(part[own[0]]), own) for own in np.split(by, cuts[1:])] if len(by) else []

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, payload in zip(left["block"], left["payload"]):
            _, contexts, anchors, least, _ = _Block.read(payload).shared(right["payload"])
            for p, mine in places(anchors):
                own = [contexts[k] for k in mine.tolist()]
                fine = (anchors[mine] // np.uint64(n_sorts) % np.uint64(FINE)).astype("<u2")
                out.append((number, p, _pack(np.fromiter(map(len, own), "<u4", len(own)), least[mine], fine, b"".join(own))))
        give_back()
        return pd.DataFrame(out, columns=["block", "part", "payload"])

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        of, ids, kinds = [], [], []
        for payload in pdf["payload"]:
            lens, least, fine, blob = _unpack(payload)
            lens = np.frombuffer(lens, "<u4").astype(np.int64)
            ends = np.cumsum(lens)
            of.append(np.fromiter((number.setdefault(blob[a:b], len(number)) for a, b in zip((ends - lens).tolist(), ends.tolist())), np.int32, len(lens)))
            ids.append(np.frombuffer(least, np.int64))
            kinds.append(np.frombuffer(fine, "<u2"))
        contexts = list(number)
        del number
        every, kind = np.full(len(contexts), NO_ID, np.int64), np.empty(len(contexts), np.int64)
        np.minimum.at(every, np.concatenate(of), np.concatenate(ids))
        kind[np.concatenate(of)] = np.concatenate(kinds)
        del kinds
        lens = np.fromiter(map(len, contexts), np.int64, len(contexts))
        sizes = lens - LENGTH + 1
        kind = kind * (1 + lens.sum() // GROUP_BYTES) // FINE
        by = np.argsort(kind, kind="stable")
        offsets = np.empty(len(by), np.int64)
        offsets[by] = np.cumsum(sizes[by]) - sizes[by]
        found = np.empty(sizes.sum(), np.int64)
        done = 0
        for mine in np.split(by, np.nonzero(np.diff(kind[by]))[0] + 1):
            least = least_ids([contexts[k] for k in mine.tolist()], every[mine], shard_bytes)
            found[done : done + len(least)] = least
            done += len(least)
        out = []
        for block, k, i in zip(pdf["block"], of, ids):
            n = sizes[k]
            at = np.repeat(offsets[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((block, int(pdf["part"].iloc[0]), _pack(np.packbits(found[at] < np.repeat(i, n)))))
        give_back()
        return pd.DataFrame(out, columns=["block", "part", "bits"])

    def strike(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in left["payload"]:
            block = _Block.read(payload)
            kept_rows = right[right["bits"].isnull()]["payload"]
            (doc, first, last), contexts, anchors, least, of = block.shared(kept_rows)
            sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) - LENGTH + 1
            offsets = np.cumsum(sizes) - sizes
            gone = np.zeros(sizes.sum(), bool)  # strings of which an id below the block's least is known
            part = dict(places(anchors))
            for p, bits in right[right["bits"].notnull()][["part", "bits"]].itertuples(index=False):
                mine = part[p]
                n = sizes[mine]
                at = np.repeat(offsets[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                gone[at] = np.unpackbits(np.frombuffer(_unpack(bits)[0], np.uint8), count=len(at)).astype(bool)
            hit = np.zeros(len(block.data), bool)  # places where a string starts that goes
            for a in range(0, len(of), STRIKE_RUNS):
                run = slice(a, a + STRIKE_RUNS)
                n = sizes[of[run]]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit[np.repeat(first[run], n) + step] = gone[np.repeat(offsets[of[run]], n) + step] | np.repeat(block.ids[doc[run]] > least[of[run]], n)
            cover = np.cumsum(hit, dtype=np.int32)
            cover[LENGTH:] -= cover[:-LENGTH].copy()
            cover = cover > 0
            data = np.frombuffer(block.data, np.uint8)
            begin = 0
            for doc_id, size in zip(block.ids.tolist(), block.lens.tolist()):
                c = cover[begin : begin + size]
                edge = np.diff(np.concatenate([[False], c, [False]]).astype(np.int8))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])]
                out.append((None if doc_id == NO_ID else doc_id, size, int(c.sum()), spans, data[begin : begin + size][~c].tobytes()))
                begin += size
        give_back()
        pdf = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
        return pdf.assign(doc_id=pdf["doc_id"].astype("Int64"))

    name = f"suffix_blocks_{uuid.uuid4().hex}"
    blocks = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, "block long, kind string, part int, payload binary")
    blocks.write.partitionBy("kind").bucketBy(parts, "block").option("compression", "none").option("path", f"{shared_dir(spark)}/leafmill/{name}").saveAsTable(name)
    table = spark.table(name)
    kept = table.filter("kind = 'docs'").select("block", "payload")
    met_name = f"suffix_anchors_{uuid.uuid4().hex}"
    met = table.filter("kind = 'anchors'").groupBy("part").applyInPandas(meet, "block long, payload binary")
    met.repartition(parts, "block").write.bucketBy(parts, "block").option("compression", "none").option("path", f"{shared_dir(spark)}/leafmill/{met_name}").saveAsTable(met_name)
    met = spark.table(met_name)
    n_sorts = max(parts, kept.count() // PART_BLOCKS)
    sent = kept.groupBy("block").cogroup(met.groupBy("block")).applyInPandas(send, "block long, part int, payload binary")
    bits = sent.groupBy("part").applyInPandas(sort, "block long, part int, bits binary").repartition(parts, "block")
    back = met.select("block", F.lit(-1).alias("part"), "payload", F.lit(None).cast("binary").alias("bits")).unionByName(bits.select("block", "part", F.lit(None).cast("binary").alias("payload"), "bits"))
    return kept.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(strike, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
