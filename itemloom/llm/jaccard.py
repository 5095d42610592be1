"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets, its components, and the links of each document.

1. Blocks exchange the upper bits of their distinct shingle hashes (once a block) to learn which may be shared.
   A set can only have a partner if enough of its shingles are shared; the others need no further work,
   and the rest drop their unshared shingles. Documents with equal sets become one.
2. The same exchange among the sets that are left counts how many hold each shingle. This gives the
   global order, rare first. Two sets with an overlap of at least c share k shingles among the first
   size - c + k of both, so only these prefixes are looked at.
3. Small ("light") sets enumerate the pairs (k = 2) of their prefix, and meet in equal pairs. Large
   ("heavy") sets would have too many: they enter the inverted lists of their prefix's shingles (k = 1),
   together with those light sets that are large enough to be partners. The boundary is the size at which
   the estimated costs (keys sent: subsets or list entries; list entries scanned) are least in sum.
   Two sets that meet are only compared if enough of both is left from there on.
4. Each set is first verified against one set only, the hub it meets most often; the links found
   make components (large-star and small-star contractions). Then all sets that meet but are in different
   components yet are verified, which loses no link between components and expands no group of copies.
5. Links are counted inside the components: a component's sets are dealt into chunks of at most about CHUNK sets and
   CHUNK_BYTES, and each pair of chunks is one cell, in which all pairs are compared by products of 0/1 matrices.
   Only counts leave a cell, so no pair is ever a row. n_links is the number of other documents that a document
   is linked with, copies included; it costs m * m / CHUNK rows for m unlike sets of one component.

Verification is exact on 64-bit shingle hashes; two different shingles are taken for equal with odds of
5e-20 a pair. Lists are kept as rows, never gathered, so a frequent shingle is spread by the join that
reads it. What the driver sees: one row per class of sizes for the boundary, and counts. Frames that are joined with
hot keys (stars' centres, large groups) come from storage or with unknown partitioning, so that Spark may split them.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; fewer
than five words are one shingle; a text of any length is one piece of work, of some 25 times its size. Rows are told
apart by their place in the input, not by their ids: a null id is nobody's component_id unless there is no other in the
component, and repeated rows or ids are rows of their own (equal texts are linked). An empty table has no rows,
and columns beside id and text play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import blocks as B

#: What it costs to send a key, in list entries read.
SENT = 4
WORDS = 5
PERCENT = 75
#: Sets, and bytes of their coded hashes, of a chunk of a component, on average.
CHUNK = 64
CHUNK_BYTES = 8 << 20
#: Rows up to which what is told of the documents of groups is broadcast (32 MB); beyond, it is joined by shuffle.
BROADCAST_KINDS = 1_000_000
#: Columns of a matrix.
WIDTH = 4096
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(block: B.Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) of a block, in order of documents and hashes."""
    data = np.frombuffer(LOWER, np.uint8)[block.data]
    starts, ends, doc = B.word_spans(data, block.ends)
    h = B.span_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=block.n)
    begin = np.concatenate([[0], np.cumsum(count)])
    hashes, docs = [], []
    for k in range(1, words + 1):
        r = B.mixed(B.rolled(h, k) + np.uint64(k * B.MIX & 0xFFFFFFFFFFFFFFFF))
        if k < words:
            at = begin[:-1][count == k]
        else:
            at = np.flatnonzero(doc[: len(r)] == doc[k - 1 :][: len(r)]) if len(r) else np.zeros(0, np.int64)
        hashes.append(r[at])
        docs.append(doc[at])
    hashes, docs = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort([hashes, docs])
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], docs[new]


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of this size needs with any partner."""
    return -(-size * percent // 100)


def partnered(rows: DataFrame, words: int, percent: int, n_buckets: int, bits: int) -> DataFrame:
    """Rows (row, id, mark, n, key, shared): key and shared hashes only of sets that may have a partner. Blocks carry the marks."""
    asked = B.sent(rows, lambda block: shingles(block, words)[0], n_buckets, bits)
    told = B.answered(asked, B.in_several)

    def finish(mine: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for uid, body in zip(mine.uid, mine.body):
            block = B.unpacked(body)
            marks = block.rows().column(0).to_pylist()
            h, doc = shingles(block, words)
            size = np.bincount(doc, minlength=block.n)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            shared = B.shared_elsewhere(h, flags, bits) > 0
            shared[order[1:][same]] = shared[order[:-1][same]] = True
            some = np.bincount(doc[shared], minlength=block.n)
            cuts = np.concatenate([[0], np.cumsum(size)])
            for i in range(block.n):
                own = None if block.ids[i] == B.NO_ID else block.ids[i]
                if size[i] and some[i] >= least_overlap(size[i], percent):
                    a, b = cuts[i], cuts[i + 1]
                    out.append((uid << B.MANY | i, own, marks[i], int(size[i]), hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest(), B.deltas(h[a:b][shared[a:b]])))
                else:
                    out.append((uid << B.MANY | i, own, marks[i], int(size[i]), None, None))
        return pd.DataFrame(out, columns=["row", "id", "mark", "n", "key", "shared"]).astype({"id": "Int64"})

    return rows.select("uid", "body").groupBy("uid").cogroup(told.groupBy("uid")).applyInPandas(finish, "row long, id long, mark long, n long, key binary, shared binary")


def ordered(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, n, prefix, unshared, tokens): a set's hashes that others have too (coded), how many it has besides, and those it is looked up by (rare first). Sets that can't have a partner other than themselves are left out. sets: node, n, shared."""
    rows, n_bytes = B.stored(sets.select(F.col("node").alias("at"), "shared", F.col("n").cast("long")), "at", "shared", [F.col("n")])
    n_buckets = B.bucket_count(sets.sparkSession, n_bytes)

    def tokens(block: B.Block) -> list[np.ndarray]:
        return [B.undeltas(block.text(i)) for i in range(block.n)]

    def count(frames):
        for frame in frames:
            for uid, body in zip(frame.uid, frame.body):
                h, times = np.unique(np.concatenate(tokens(B.unpacked(body))), return_counts=True)
                parts = B.bucketed(h, n_buckets)
                yield pd.DataFrame({"bucket": np.array([p[0] for p in parts], np.int32), "uid": np.full(len(parts), uid, np.int64), "hashes": [B.deltas(h[a:b]) for _, a, b in parts], "times": [B.planes(times[a:b].astype(np.uint32)) for _, a, b in parts]})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        h, row, order = B.merged(frame)
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = np.cumsum(first) - 1
        times = np.concatenate([B.unplanes(x, np.uint32) for x in frame.times])
        sums = np.minimum(np.bincount(group, times[order]), 0xFFFFFFFF)[group].astype(np.uint32)
        back = np.empty(len(h), np.uint32)
        back[order] = sums
        parts = np.split(back, np.cumsum(np.bincount(row, minlength=len(frame)))[:-1])
        return pd.DataFrame({"uid": frame.uid, "bucket": frame.bucket.astype("int32"), "flags": [B.planes(p) for p in parts]})

    told = rows.select("uid", "body").mapInPandas(count, "bucket int, uid long, hashes binary, times binary").groupBy("bucket").applyInPandas(total, "uid long, bucket int, flags binary")

    def finish(mine: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for body in mine.body:
            block = B.unpacked(body)
            size = block.rows().column(0).to_numpy()
            own = tokens(block)
            distinct = np.unique(np.concatenate(own))
            held = np.concatenate([B.unplanes(x, np.uint32) for x in flags.sort_values("bucket")["flags"]])
            for i, h in enumerate(own):
                df = held[np.searchsorted(distinct, h)]
                h, df = h[df > 1], df[df > 1]
                need = int(least_overlap(size[i], percent))
                if need < 2 or len(h) < need:
                    continue
                order = np.lexsort([h, df])[: len(h) - need + 2]
                out.append((block.ids[i], int(size[i]), h[order].view(np.int64), int(size[i]) - len(h), B.deltas(h)))
        return pd.DataFrame(out, columns=["node", "n", "prefix", "unshared", "tokens"])

    return rows.select("uid", "body").groupBy("uid").cogroup(told.groupBy("uid")).applyInPandas(finish, "node long, n long, prefix array<long>, unshared long, tokens binary")


def boundary(sets: DataFrame) -> int:
    """The size up to which sets are light: of 2 ** (i / 2), the one with the least estimated cost.

    An entry of a list is read once, beside the list's hub, and once more if the list is still open later.
    """
    p = F.size("prefix").cast("double")
    rows = sets.groupBy(F.ceil(2 * F.log2("n")).alias("c")).agg(F.sum(SENT * p * (p - 1) / 2).alias("light"), F.sum((SENT + 2) * p).alias("heavy")).collect()
    best = min(range(1, 129), key=lambda c: (sum(r.light for r in rows if r.c <= c) + sum(r.heavy for r in rows if r.c > c - 1), c))
    return int(2 ** (best / 2))


def meeting_keys(sets: DataFrame, light: int, percent: int) -> DataFrame:
    """Rows (heavy, key, node, n, lost, rest): where each set meets others. lost: its unshared shingles in
    thousandths; rest: how many of its shingles come no earlier than the key's first."""
    prefix, unshared = F.col("prefix"), F.col("unshared")
    lost = F.floor(unshared * 1000 / F.col("n")).alias("lost")
    rest = lambda i: F.col("n") - unshared - i
    two = lambda x, i, y: F.struct(F.xxhash64(x, y).alias("key"), rest(i).alias("rest"))
    twos = F.flatten(F.transform(prefix, lambda x, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda y: two(x, i, y))))
    ones = F.transform(F.slice(prefix, 1, F.greatest(F.size(prefix) - 1, F.lit(1))), lambda x, i: F.struct(x.alias("key"), rest(i).alias("rest")))
    small = sets.where(F.col("n") <= light).select(F.lit(False).alias("heavy"), "node", "n", lost, F.explode(twos).alias("k"))
    large = sets.where(F.col("n") * 100 >= F.lit(light) * percent).select(F.lit(True).alias("heavy"), "node", "n", lost, F.explode(ones).alias("k"))
    return small.union(large).select("heavy", "k.key", "node", "n", "lost", "k.rest")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Both joins read one and the same exchange of the sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def check(frames):
        for frame in frames:
            last, held = None, None  # rows of one partner come one behind the other
            good = np.zeros(len(frame), bool)
            for i, (na, nb, b, ta, tb) in enumerate(zip(frame.na, frame.nb, frame.b, frame.ta, frame.tb)):
                if b != last:
                    last, held = b, B.undeltas(tb)
                own = B.undeltas(ta)
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                both = int((held[at] == own).sum())
                good[i] = both * 100 >= (na + nb - both) * percent
            yield frame.loc[good, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInPandas(check, "a long, b long")


def may_link(n, rest, n2, rest2, percent: int):
    """Whether two sets can link if this key's first shingle is the first they share: the sizes are near enough, and
    enough of both is left. Of all keys where two linked sets meet, it is true of the one of their first common shingles."""
    return (F.least(n, n2) * 100 >= F.greatest(n, n2) * percent) & (F.least(rest, rest2) * (100 + percent) >= (n + n2) * percent)


def splittable(df: DataFrame) -> DataFrame:
    """df without its partitioning, so that a join has an exchange on either side, of which Spark may split large parts."""
    return df.coalesce(1 << 20)


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for all nodes in a link (a, b)."""
    edges = B.kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def print_of(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = print_of(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = splittable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = splittable(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        edges = B.kept(small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = print_of(edges)
        if now == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        seen = now


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, component) for the sets of `ordered` that have a link."""
    keys = meeting_keys(sets, boundary(sets), percent)
    # A list's hub is the set with the least unshared shingles: an original rather than one of its changed copies.
    hubs = splittable(keys.groupBy("heavy", "key").agg(F.min(F.struct("lost", "node", "n", "rest")).alias("hub"), F.count("*").alias("c")).where("c > 1"))
    met = keys.join(hubs, ["heavy", "key"]).where((F.col("node") != F.col("hub.node")) & may_link(F.col("n"), F.col("rest"), F.col("hub.n"), F.col("hub.rest"), percent))
    often = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("c"))
    first = often.groupBy(F.col("node").alias("a")).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("hub").alias("h"))).alias("m")).select("a", F.col("m.h").alias("b"))
    links = B.kept(verified(first, sets, percent))
    of = B.kept(components(links))
    placed = keys.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = splittable(placed.groupBy("heavy", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("heavy", "key"))
    open_keys = B.kept(placed.join(mixed, ["heavy", "key"]).select("heavy", "key", "node", "n", "rest", "component"))
    other = open_keys.select("heavy", "key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("component").alias("y"))
    pairs = open_keys.join(other, ["heavy", "key"]).where((F.col("component") < F.col("y")) & may_link(F.col("n"), F.col("rest"), F.col("nb"), F.col("rb"), percent)).select(F.col("node").alias("a"), "b").distinct()
    more = verified(pairs, sets, percent)
    return components(links.union(more))


def cell_links(size: np.ndarray, tokens: list[np.ndarray], times: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """How many documents each set is linked with: those of the other side, or of the same if there is one side only. times: documents of each set."""
    of = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, column, held = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    some = held[column] > 1
    _, column = np.unique(column[some], return_inverse=True)
    of = of[some]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    two = side.any() and not side.all()
    a, b = (np.flatnonzero(~side), np.flatnonzero(side)) if two else (np.arange(len(size)),) * 2
    both = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        i, j = np.searchsorted(column, [c, c + WIDTH])
        x = np.zeros((len(size), WIDTH), np.float32)
        x[of[i:j], column[i:j] - c] = 1
        both += x[a] @ x[b].T
    link = both * 100 >= (size[a][:, None] + size[b][None, :] - both) * percent
    if not two:
        np.fill_diagonal(link, False)
        return link @ times
    out = np.empty(len(size), np.int64)
    out[a], out[b] = link @ times[b], times[a] @ link
    return out


def link_counts(of: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, links): how many documents of other sets each set is linked with. of: node, component, times (documents of the set)."""
    spark = sets.sparkSession
    members = sets.select("node", "n", "tokens").join(of.select("node", "component", "times"), "node")
    share = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("tokens")) / CHUNK_BYTES)).cast("int").alias("k")
    sizes = B.kept(members.groupBy("component").agg(share, F.sum(F.length("tokens")).alias("bytes")))
    sent = sizes.agg(F.sum(F.col("k") * F.col("bytes"))).first()[0] or 0
    parts = max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(sent) // CHUNK_BYTES))
    dealt = members.join(sizes.select("component", "k"), "component").withColumn("own", F.expr("int(pmod(xxhash64(node), k))"))
    cells = dealt.select("component", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"), "node", "n", "times", "tokens")
    cells = cells.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("part", F.expr(f"pmod(xxhash64(component, i, j), {parts})"))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), cell in frame.groupby(["component", "i", "j"], sort=False):
            side = (cell.own == j).to_numpy() if i != j else np.zeros(len(cell), bool)
            if i == j or side.any() and not side.all():
                links = cell_links(cell.n.to_numpy(), [B.undeltas(t) for t in cell.tokens], cell.times.to_numpy(), side, percent)
                out.append(pd.DataFrame({"node": cell.node, "links": links}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": []}, dtype="int64")

    each = cells.select("part", "component", "i", "j", "own", "node", "n", "times", "tokens").groupBy("part").applyInPandas(count, "node long, links long")
    return each.groupBy("node").agg(F.sum("links").alias("links"))


def rows_joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row (a number of its own), id, mark (xxhash64 of the text), n_shingles, group (the least row of its component), component_id, n_links."""
    rows, n_bytes = B.stored(docs, id_col, text_col, [F.xxhash64(text_col).alias("__mark")])
    each = B.kept(partnered(rows, words, percent, B.bucket_count(docs.sparkSession, n_bytes), B.screening_bits(n_bytes)))
    del rows
    keyed = each.where("key IS NOT NULL")
    nodes = B.kept(keyed.groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("times")))
    full = keyed.groupBy("key").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("shared").alias("shared"))
    sets = B.kept(ordered(full.select("node", "n", "shared"), percent))
    found = B.kept(linked(sets, percent))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())  # the least node is nobody's link
    of = B.kept(found.join(nodes.select("node", "least", "times"), "node"))
    links = B.kept(link_counts(of, sets, percent))
    del sets
    whole = splittable(of.groupBy("component").agg(F.min("least").alias("whole")))
    known = of.select("node", "component").join(whole, "component").join(links, "node", "left")
    placed = nodes.join(known, "node", "left").select("key", F.coalesce("component", "node").alias("group"), F.coalesce("whole", "least").alias("component_id"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    placed = B.kept(placed)
    joined = each.select("row", "id", "mark", "n", "key").join(placed, "key", "left")
    B.release(docs.sparkSession)
    return joined.select("row", "id", "mark", F.col("n").alias("n_shingles"), F.coalesce("group", "row").alias("group"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links."""
    return rows_joined(docs, words, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of the least id that isn't null, or else the first one.

    Rows to drop are told by id and hash of the text; where the row that stays has a twin in both, one of them is taken.
    """
    joined = B.kept(rows_joined(docs, words, percent, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("first")
    groups = joined.groupBy("group").agg(first, F.count("*").alias("n")).where("n > 1").select("group", F.col("first.row").alias("stays"))
    several = B.kept(joined.join(splittable(groups), "group").select("id", "mark", (F.col("row") == F.col("stays")).alias("stays")))
    kinds = B.kept(several.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    few = kinds.count() <= BROADCAST_KINDS
    own = B.beside(docs, id=F.col(id_col), mark=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))
    stay = own.join(F.broadcast(kinds) if few else kinds, same, "left").where("stays IS NULL OR (stays AND n = 1)").select("row")
    twins = kinds.where("stays AND n > 1")
    if not twins.isEmpty():
        stay = stay.unionByName(own.join(twins, same, "left_semi").dropDuplicates(["id", "mark"]).select("row"))
    return B.unpacked_rows(stay, docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return join(docs)
