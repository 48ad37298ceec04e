"""An exact Jaccard self-join on word n-grams by token-combination prefixes.

Two sets with a Jaccard similarity of at least t share a token among the first
``p = n - ceil(t n) + 1`` of each, in any order of tokens that is the same for
all. The order here puts rare tokens first, so most documents' prefixes hold
only tokens of their own and meet nothing. How many sets have a token is counted
for a quarter of the token space, chosen by hash. First in the order come that
quarter's rare tokens, then all others by their count among the documents whose
prefix the rare ones don't fill; those are few and are read again for it.

Tokens are of two kinds. A rare one is indexed by itself. Frequent ones are
dealt by hash into groups, and pairs of tokens of the same group are indexed: two
documents that have no pair of a group in common share at most one token of it,
so a group of c frequent tokens in a prefix counts as c - 1, and the prefix is
extended until the counts add up to p. The number of groups goes by the size of
the documents, in bands; a document is indexed in each band that a partner may
be in.

Documents with equal sets are one class and only its smallest doc_id is joined.
Within a list of documents that share an index entry not all pairs are made.
First each is compared with the list's most central document, the one with the
smallest share of tokens of its own. Where a list isn't yet in one component, those
of its documents go that can link with no other of it: a document's reach is how many of its
tokens any other may have at all, and two documents of reach r and s share
min(r, s) tokens at the most. That ends lists of a passage that many otherwise
different texts have. The documents that the lists left over connect form a group, and
those outside its largest component are compared with all others of it. Where these
are one block of documents at the most, that is a matrix product a block of the group,
which gives links and not pairs. So a group of n near copies costs about n comparisons.
Groups of more, as of texts put together from the same passages in other ways, are
indexed again. First those leave that can link with none: two sets differ by what each has of
its own against one set of the group, its pivot, less twice what they share of that. Then the
others are indexed by parts of their sets. Sets that link differ in few tokens; dealt by hash into
somewhat more parts than that, they have many equal parts. Parts come in
groups of eight, as many as make two equal parts fall into one group, and pairs of
parts are indexed: some nine tokens of each set, which unlike texts seldom have all in
common. Of the pairs that meet there those with too many unequal parts go before whole sets
are compared. No link between components is missed.

Tokens are 64-bit hashes of n-grams while candidates are searched; a set's name and
the verification of a link use a second, independent hash besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.llm.common import looked_up, materialise, mixed, release, slices, table
from buswright.llm.components import components
from buswright.llm.minhash import shingles

#: Ids up to this many are sent to all tasks (16 MB); more are joined by a shuffle.
_BROADCAST_ROWS = 2_000_000
#: Documents of a group that is compared pair by pair, and of one side of a block in a larger one.
_SMALL_GROUP, _BLOCK = 64, 1024
#: Tokens of all documents of a block, about.
_BLOCK_TOKENS = 2_000_000
#: Parts of a set that are indexed in pairs, parts of a sketch for each of these, the most that a sketch has, and index entries that a task makes at a time.
_TOGETHER, _FINER, _SKETCH, _ENTRIES = 8, 8, 4096, 500_000
#: Times that documents which can link with none leave a group, and significant bits of the sizes by which that is found.
_LEAVE, _BITS = 2, 6
_QUARTER = np.uint64(1) << np.uint64(62)


@dataclass(frozen=True)
class Rule:
    """Texts link when 100 * intersection >= percent * union of their n-grams of ``width`` words."""

    width: int = 4
    percent: int = 85
    #: A token that more sets than this have is a frequent one.
    frequent: int = 256

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def bands(self, n: int) -> range:
        """Size bands that a partner of a set of n tokens may be in."""
        return range(_band(-(-n * self.percent // 100)), _band(n * 100 // self.percent) + 1)

    def groups(self, band: int) -> int:
        return max(1, self.prefix(int(1.25**band)) // 4)


def _band(n: int) -> int:
    return int(np.log(max(n, 1)) / np.log(1.25))


def token_sets(texts: pa.Array, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text in ascending order, and the texts' bounds in them."""
    keys, bounds = shingles(texts, width, seed)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[first], np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(bounds) - 1))].astype(np.int64)


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, sig_a, sig_b, counted, tokens: the counted quarter of each set, null for a set
    that the same task has met before with a doc_id, and for rows without doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for part in slices(batches, most=1_000_000):
            keys, bounds = token_sets(part.column("text"), rule.width)
            n, some = np.diff(bounds), np.diff(bounds) > 0
            sig = np.zeros((2, len(n)), np.uint64)
            if len(keys):
                # the second name is of the second hash
                again, at = token_sets(part.column("text"), rule.width, 1)
                sig[0, some] = np.add.reduceat(mixed(keys), bounds[:-1][some])
                sig[1, some] = np.add.reduceat(mixed(again), at[:-1][some])
            # keys are sorted, so the counted quarter is the beginning of each set
            counted = np.add.reduceat((keys < _QUARTER).astype(np.int64), bounds[:-1][some]) if len(keys) else np.zeros(0, np.int64)
            count = np.zeros(len(n), np.int64)
            count[some] = counted
            tokens, known = [], part.column("doc_id").is_valid().to_pylist()
            for i, (a, size, c) in enumerate(zip(bounds[:-1].tolist(), n.tolist(), count.tolist(), strict=True)):
                name = (int(sig[0, i]), int(sig[1, i]))
                if not size or not known[i] or name in met:
                    tokens.append(None)
                    continue
                met.add(name)
                tokens.append(keys[a : a + c].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), pa.array(count, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["doc_id", "n", "sig_a", "sig_b", "counted", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, counted long, tokens array<long>")


def _classes(sets: DataFrame) -> DataFrame:
    """sig_a, sig_b, low, doc_id, n, counted: a row for each distinct set, low its smallest doc_id and doc_id
    the smallest of those that have its tokens."""
    with_tokens = F.when(F.col("tokens").isNotNull(), F.col("doc_id"))
    return sets.where("n > 0").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("low"), F.min(with_tokens).alias("doc_id"), F.min("n").alias("n"), F.min("counted").alias("counted"), F.count(F.lit(1)).alias("copies"))


def signatures(n: int, need: int, counts: np.ndarray, tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """Index entries of a set of n tokens for ``need`` places of its prefix.

    ``tokens`` come in the common order and ``counts`` say how many sets have each.
    """
    if need <= 0:
        return np.zeros(0, np.uint64)
    often = counts > rule.frequent
    if not often[:need].any():
        return mixed(tokens[:need])
    out = []
    for band in rule.bands(n):
        groups = rule.groups(band)
        group = (mixed(tokens ^ np.uint64(0xA5A5)) % np.uint64(groups)).astype(np.int64)
        seen, got = [[] for _ in range(groups)], 0
        for end in range(len(tokens)):
            if got >= need:
                break
            if often[end]:
                mine = seen[group[end]]
                got += 1 if mine else 0
                out += [mixed(mixed(np.array([t], np.uint64)) + tokens[end : end + 1] + np.uint64(band))[0] for t in mine]
                mine.append(tokens[end])
            else:
                out.append(mixed(tokens[end : end + 1])[0])
                got += 1
    return np.unique(np.array(out, np.uint64))


ENTRIES = "sig long, doc long, n long, own int, reach long"


def _packed(rows: list[tuple[np.ndarray, int, int, int, int]]) -> pa.RecordBatch:
    """Index entries of documents: (entries, doc_id, n, own, reach)."""
    size = [len(r[0]) for r in rows]
    keys = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint64)
    columns = [pa.array(keys.view(np.int64))] + [pa.array(np.repeat(np.array([r[k] for r in rows], np.int64), size)) for k in (1, 2)]
    own = pa.array(np.repeat(np.array([r[3] for r in rows], np.int32), size))
    reach = pa.array(np.repeat(np.array([r[4] for r in rows], np.int64), size))
    return pa.RecordBatch.from_arrays([*columns, own, reach], names=["sig", "doc", "n", "own", "reach"])


def _common(sets: DataFrame) -> DataFrame:
    """token, doc_id, sets: the tokens that several documents have, and how many."""
    rows = sets.select("doc_id", F.explode("tokens").alias("token"))
    return rows.join(rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "token")


def _index(docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """sig, doc, n, own, reach: the index entries of each class, own its share of tokens of its own in
    thousandths and reach the number of its tokens that others of such an entry may have."""
    classes = _classes(sets)
    listed = _common(sets.where("tokens IS NOT NULL")).groupBy("doc_id").agg(F.collect_list(F.struct("sets", "token")).alias("tokens"))
    # of the documents that stand for a class in their own tasks the smallest goes on
    listed = classes.select("doc_id", "n", "counted").join(listed, "doc_id", "left")
    alone = F.col("counted") - F.coalesce(F.size("tokens"), F.lit(0))
    prefix = F.col("n") - F.ceil(F.col("n") * rule.percent / F.lit(100)) + 1
    rare = F.coalesce(F.filter("tokens", lambda t: t["sets"] <= rule.frequent), F.expr("cast(array() as array<struct<sets:bigint,token:bigint>>)"))
    listed = listed.withColumn("alone", alone).withColumn("need", prefix - alone).where("need > 0")
    listed = listed.select("doc_id", "n", "need", "alone", F.array_sort(rare).alias("rare"), (1000 * F.col("alone") / F.greatest("counted", F.lit(1))).cast("int").alias("own"))
    listed = materialise(listed, "ngram-listed")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, need, own, alone_, tokens in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                out.append((mixed(np.asarray(tokens.values)[:need].view(np.uint64)), doc, n, own, n - alone_))
            yield _packed(out)

    enough = F.size("rare") >= F.col("need")
    first = listed.where(enough).select("doc_id", "n", "need", "own", "alone", "rare.token").mapInArrow(plain, ENTRIES)

    # documents whose rare tokens don't make a prefix go on into all their other tokens
    short = listed.where(~enough)
    whole = _whole_sets(docs, short.select("doc_id"), rule)
    met = _common(whole).groupBy("doc_id").agg(F.collect_list(F.struct("sets", "token")).alias("others"))
    short = short.join(met, "doc_id", "left").select("doc_id", "n", "need", "own", "alone", "rare.token", F.col("others.sets").alias("sets"), F.col("others.token").alias("other"))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (doc, n, need, own, alone_) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                rare_ = np.asarray(batch.column(5)[i].values).view(np.uint64)
                sets_, other = (np.asarray(batch.column(k)[i].values) if batch.column(k)[i].is_valid else np.zeros(0, np.int64) for k in (6, 7))
                other = other.view(np.uint64)
                left = ~np.isin(other, rare_)
                sets_, other = sets_[left], other[left]
                order = np.lexsort((other, sets_))
                # tokens that no other of these documents has come first
                missing = n - alone_ - len(rare_) - len(other)
                more = signatures(n, need - len(rare_) - missing, sets_[order], other[order], rule)
                # others of the further entries are documents like this one, which have none of the missing tokens
                out += [(mixed(rare_), doc, n, own, n - alone_), (more, doc, n, own, n - alone_ - missing)]
            yield _packed(out)

    return first.union(short.mapInArrow(further, ENTRIES))


def _whole_sets(docs: DataFrame, wanted: DataFrame, rule: Rule, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """doc_id and all tokens, ascending, of the documents wanted, by each of the hashes: tokens, tokens1."""
    wanted = materialise(wanted.distinct(), "ngram-wanted")
    slim = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    chosen = slim.join(F.broadcast(wanted) if wanted.count() <= _BROADCAST_ROWS else wanted, "doc_id", "left_semi")
    names = ["tokens" + (str(seed) if seed else "") for seed in seeds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1_000_000):
            columns = [part.column("doc_id").cast(pa.int64())]
            for seed in seeds:
                keys, bounds = token_sets(part.column("text"), rule.width, seed)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    out = materialise(chosen.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} array<long>" for name in names)), "ngram-sets")
    release(wanted)
    return out


def _verified(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The table of pairs (a, b) that link, by the whole sets of both under either hash."""
    sets = _whole_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), rule, (0, 1))
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"), F.col("tokens1").alias("x1"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"), F.col("tokens1").alias("y1"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    for x, y in (("x", "y"), ("x1", "y1")):
        common = F.size(F.array_intersect(x, y))
        both = both.where(common * 100 >= (F.size(x) + F.size(y) - common) * rule.percent)
    links = materialise(both.select("a", "b"), "ngram-links")
    release(sets, pairs)
    return links


def _may_link(n: Column, m: Column, reach: Column, other: Column, rule: Rule) -> Column:
    """Whether sets of sizes n and m may link that share no more tokens than either's reach."""
    near = F.least(n, m) * 100 >= F.greatest(n, m) * rule.percent
    return near & (F.least(reach, other) * (100 + rule.percent) >= (n + m) * rule.percent)


def _open_lists(entries: DataFrame) -> DataFrame:
    """sig, hub, size, reach and n (the largest and the smallest) of lists whose documents aren't all in one component."""
    lists = entries.groupBy("sig").agg(
        F.min(F.struct("own", "doc")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.count(F.lit(1)).alias("size"), F.max("reach").alias("most"), F.min("n").alias("least"),
    )
    return lists.where("low != high").select("sig", F.col("hub.doc").alias("hub"), "size", "most", "least")


def _rest(docs: DataFrame, shared: DataFrame, named: DataFrame, rule: Rule) -> DataFrame | None:
    """Links between components in lists whose documents aren't all in one; None without such lists.

    ``shared`` are the index entries that several documents have. Documents that
    open lists connect form a group. In a group, the documents outside its largest
    component are compared with all others: pair by pair in small groups, as one block
    with blocks of all in larger ones, by an index of parts where they are many.
    """
    entries = shared.join(named.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", "n", "own", "reach", F.coalesce("component", "doc").alias("component"))
    entries = materialise(entries, "ngram-entries")
    total = entries.count()
    lists = materialise(_open_lists(entries), "ngram-lists")
    # the best partner that a list may hold has its largest reach and its smallest size
    able = _may_link(F.col("n"), F.greatest("least", F.ceil(F.col("n") * rule.percent / 100)), F.col("reach"), F.col("most"), rule)
    able = looked_up(entries, lists.where("size > 1"), ["sig"], "size", total).where(able).select(*entries.columns)
    able = materialise(able, "ngram-able")
    release(lists)
    lists = materialise(_open_lists(able), "ngram-lists")
    open_ = looked_up(able, lists, ["sig"], "size", total).select("doc", "component", "hub", "n", "reach")
    open_ = materialise(open_.groupBy("doc", "component", "hub").agg(F.max("n").alias("n"), F.max("reach").alias("reach")), "ngram-open")
    release(able, lists)
    if not open_.limit(1).count():
        return None
    groups = components(open_.where("doc != hub"), "doc", "hub").toDF("doc", "g")
    members = open_.groupBy("doc").agg(F.max("component").alias("component"), F.max("n").alias("n"), F.max("reach").alias("reach"))
    members = materialise(members.join(groups, "doc"), "ngram-grouped")
    parts = members.groupBy("g", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    parts = parts.groupBy("g").agg(F.max(F.struct("size", "component", "tokens")).alias("main"), F.sum("size").alias("all"), F.sum("tokens").alias("tokens"))
    members = looked_up(members, parts, ["g"], "all", members.count())
    blocks = lambda rows, tokens: F.ceil(F.greatest(rows / _BLOCK, tokens / _BLOCK_TOKENS)).cast("int")
    members = members.select(
        "g", "doc", "n", "reach", "component", "all", (F.col("component") != F.col("main.component")).alias("odd"),
        blocks(F.col("all"), F.col("tokens")).alias("columns"), blocks(F.col("all") - F.col("main.size"), F.col("tokens") - F.col("main.tokens")).alias("rows"),
    )
    members = materialise(members, "ngram-members")

    few = members.where(F.col("all") <= _SMALL_GROUP)
    odd = few.where("odd").select("g", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("reach").alias("far"), F.col("component").alias("other"))
    pairs = few.select("g", F.col("doc").alias("a"), "n", "reach", "component").join(odd, "g")
    pairs = pairs.where((F.col("component") != F.col("other")) & _may_link(F.col("n"), F.col("m"), F.col("reach"), F.col("far"), rule))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = members.where(F.col("all") > _SMALL_GROUP)
    alike, mixed_up = many.where("rows = 1"), many.where("rows > 1")
    if alike.limit(1).count():
        pairs = pairs.union(_blocks(docs, alike, rule))
    if mixed_up.limit(1).count():
        pairs = pairs.union(_by_parts(docs, mixed_up, rule))
    links = _verified(docs, materialise(pairs.distinct(), "ngram-rest"), rule)
    release(entries, members)
    return links


def _blocks(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of large groups that link by the first hash, a block of documents outside the main component with a block of all at a time.

    A task has two blocks of ``_BLOCK`` documents at the most and counts common
    tokens by a product of matrices. A document gives one link for each component
    that it meets.
    """
    sets = _whole_sets(docs, members.select(F.col("doc").alias("doc_id")), rule)
    at, odd_at = F.pmod(F.xxhash64("doc"), F.col("columns")).cast("int"), F.pmod(F.xxhash64("doc"), F.col("rows")).cast("int")
    rows, columns = F.col("rows"), F.col("columns")
    as_row = F.transform(F.sequence(F.lit(0), columns - 1), lambda j: F.struct(odd_at.alias("i"), j.alias("j"), F.lit(True).alias("row")))
    as_column = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.struct(i.alias("i"), at.alias("j"), F.lit(False).alias("row")))
    placed = members.select("g", "doc", "component", F.explode(F.when(F.col("odd"), F.concat(as_row, as_column)).otherwise(as_column)).alias("p"))
    placed = placed.join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("g", "p.i", "p.j", "p.row", "doc", "component", "tokens")
    found = materialise(placed.groupBy("g", "i", "j").applyInArrow(lambda t: block_links(t, rule), "a long, b long"), "ngram-blocks")
    release(sets)
    return found


def block_links(block: pa.Table, rule: Rule) -> pa.Table:
    """The links between a block's rows and its other documents, one for each document and component."""
    row = np.asarray(block.column("row").combine_chunks())
    doc, component = block.column("doc").to_numpy(), block.column("component").to_numpy()
    lists = block.column("tokens").combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    token, column = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    place = np.where(row, np.cumsum(row) - 1, np.cumsum(~row) - 1)
    common = np.zeros((int(row.sum()), int((~row).sum())), np.float32)
    if common.size:
        owner = np.repeat(np.arange(len(size)), size)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, len(token), 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            left, right = np.zeros((common.shape[0], 4096), np.float32), np.zeros((common.shape[1], 4096), np.float32)
            own, at = owner[a:b], column[a:b] - low
            left[place[own[row[own]]], at[row[own]]] = 1
            right[place[own[~row[own]]], at[~row[own]]] = 1
            common += left @ right.T
    both = size[row][:, None] + size[~row][None, :] - common
    i, j = np.nonzero((common * 100 >= both * rule.percent) & (doc[row][:, None] != doc[~row][None, :]))
    a, b, met = doc[row][i], doc[~row][j], component[~row][j]
    _, first = np.unique(np.stack([a, met]), axis=1, return_index=True)
    return pa.table({"a": pa.array(a[first], pa.int64()), "b": pa.array(b[first], pa.int64())})


def size_bands(most: int) -> np.ndarray:
    """First sizes of the bands of sizes up to ``most``, each a tenth above the one before."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 11 // 10))
    return np.array(edges, np.int64)


def most_unequal(n: int, m: int, rule: Rule) -> int:
    """The most tokens that only one of two sets of these sizes has, if they link."""
    return (n + m) * (100 - rule.percent) // (100 + rule.percent)


def set_parts(keys: np.ndarray, rule: Rule) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Of a set's tokens, for each band that the smaller set of a link may be in: the band, whether the
    set is in it itself, a sketch of 16 bits a part, and the index entries.

    Two sets that link have an entry in common in the band of the smaller. They
    differ in d tokens at the most and have as many unequal parts at the most; of 8 k
    parts in k groups, with 7 k > d, more than k are equal, so two of one group are.
    """
    n = len(keys)
    edges = size_bands(n)
    band = lambda size: int(np.searchsorted(edges, size, side="right")) - 1
    one, two = np.triu_indices(_TOGETHER, 1)
    values, places = mixed(keys + np.uint64(0x2545F491)), mixed(keys ^ np.uint64(0x9E3779B9))
    for b in range(band(-(-n * rule.percent // 100)), band(n) + 1):
        top = int(edges[b + 1]) - 1
        groups = most_unequal(top, top * 100 // rule.percent, rule) // (_TOGETHER - 1) + 1
        count = groups * _TOGETHER
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, (places % np.uint64(count)).astype(np.int64), values)
        sums = mixed(sums + np.uint64(b << 32) + mixed(np.arange(count, dtype=np.uint64)))
        grid = sums.reshape(groups, _TOGETHER)
        entries = mixed(mixed(grid[:, one]) + grid[:, two]).ravel()
        # unequal parts are fewer than unequal tokens where two of these fall into one part: seldom, in finer parts
        fine = np.zeros(count * _FINER, np.uint64)
        np.add.at(fine, (places % np.uint64(len(fine))).astype(np.int64), values)
        yield b, b == band(n), mixed(fine[:_SKETCH]).astype(np.uint16), entries


def _links_at_most(n: Column, m: Column, away: Column, far: Column, shared: Column, other: Column, rule: Rule) -> Column:
    """Whether sets of sizes n and m may link that differ from a third set in ``away`` and ``far`` tokens, of which they
    have no more than the smaller of ``shared`` and ``other`` in common."""
    unequal = F.floor((n + m) * (100 - rule.percent) / F.lit(100 + rule.percent))
    return 2 * F.least(shared, other) >= away + far - unequal


def _able_members(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """g, doc, component, odd, n, away, shared, tokens of the members that may link with one of another component.

    Sets are seen by what they differ in from their group's pivot, the set with the fewest tokens of its own:
    ``away`` tokens that only one of both has, of which ``shared`` are so for other members too. Two sets differ in
    the sum of both but for twice what they share. So texts of one origin with changes of their own, each too many
    for a link, leave the group without being compared.
    """
    rows = members.select("g", "doc", "component", "odd", "n", "reach").join(sets.withColumnRenamed("doc_id", "doc"), "doc")
    pivots = rows.groupBy("g").agg(F.min_by("tokens", F.struct((F.col("n") - F.col("reach")) / F.col("n"), "doc")).alias("pivot"))
    differ = F.concat(F.array_except("tokens", "pivot"), F.array_except("pivot", "tokens"))
    # such groups have over a block of members, so pivots are few
    rows = rows.join(F.broadcast(pivots), "g").select("g", "doc", "component", "odd", "n", "tokens", differ.alias("differ"))
    rows = materialise(rows.withColumn("away", F.size("differ").cast("long")), "ngram-away")
    for _ in range(_LEAVE):
        # a token of one group is none of another
        of_group = rows.select(F.col("doc").alias("doc_id"), F.transform("differ", lambda t: F.xxhash64("g", t)).alias("tokens"))
        shared = _common(of_group).groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared")).withColumnRenamed("doc_id", "doc")
        known = materialise(rows.drop("shared").join(shared, "doc", "left").fillna(0, ["shared"]), "ngram-shared-away")
        cells = known.groupBy("g", (-_rounded(-F.col("n"))).alias("m"), _rounded(F.col("away")).alias("far"))
        cells = cells.agg(F.max("shared").alias("any"), F.max(F.when(F.col("odd"), F.col("shared"))).alias("odd"))
        cells = cells.groupBy("g").agg(F.collect_list(F.struct("m", "far", "any", "odd")).alias("cells"))

        def may(c: Column) -> Column:
            # documents of the main component need one outside it
            other = F.when(F.col("odd"), c["any"]).otherwise(c["odd"])
            m = F.least(c["m"], F.floor(F.col("n") * 100 / rule.percent))
            link = _links_at_most(F.col("n"), m, F.col("away"), c["far"], F.col("shared"), other, rule)
            return other.isNotNull() & (c["m"] * 100 >= F.col("n") * rule.percent) & link

        left = materialise(known.join(F.broadcast(cells), "g").where(F.exists("cells", may)).drop("cells"), "ngram-left")
        release(rows, known)
        rows = left
    return rows


def _rounded(size: Column) -> Column:
    """A size, or its negative, with ``_BITS`` significant bits, rounded down."""
    beyond = F.greatest(F.length(F.bin(F.abs(size))) - _BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, beyond), beyond)


def _by_parts(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of documents outside their group's main component with others that have two parts of a set in
    common and don't differ in more parts than sets that link may."""
    sets = _whole_sets(docs, members.select(F.col("doc").alias("doc_id")), rule)
    able = _able_members(members, sets, rule)
    placed = able.select("doc", "component", "odd", "g", "away", "shared", "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            lists = batch.column(6)
            for i, about in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                keys = np.asarray(lists[i].values).view(np.uint64)
                for b, own, sketch, entries in set_parts(keys, rule):
                    rows.append((*about, len(keys), b, own, sketch.tobytes(), entries.view(np.int64)))
                    held += len(entries)
                if held > _ENTRIES:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
        names = ["doc", "component", "odd", "g", "away", "shared", "n", "band", "own", "sketch", "sigs"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc long, component long, odd boolean, g long, away long, shared long, n long, band int, own boolean, sketch binary, sigs array<long>"
    parts = materialise(placed.mapInArrow(cut, schema), "ngram-parts")
    entries = parts.select("doc", "component", "odd", "g", "away", "shared", "n", "band", "own", F.explode("sigs").alias("sig"))
    odd = entries.where("odd").select("g", "sig", F.col("doc").alias("a"), "component", "n", "own", "band", "away", "shared")
    other = entries.select("g", "sig", F.col("doc").alias("b"), F.col("component").alias("met"), F.col("n").alias("m"), F.col("own").alias("home"), F.col("away").alias("far"), F.col("shared").alias("other"))
    pairs = odd.join(other, ["g", "sig"]).where((F.col("component") != F.col("met")) & (F.col("own") | F.col("home")))
    pairs = pairs.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * rule.percent)
    pairs = pairs.where(_links_at_most(*(F.col(c) for c in ("n", "m", "away", "far", "shared", "other")), rule))
    met = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "band").distinct(), "ngram-met")
    pairs = met
    for end, size, sketch in (("a", "n", "x"), ("b", "m", "y")):
        pairs = pairs.join(parts.select(F.col("doc").alias(end), "band", F.col("n").alias(size), F.col("sketch").alias(sketch)), [end, "band"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            if batch.num_rows:
                limit = most_unequal(batch.column(2).to_numpy(), batch.column(3).to_numpy(), rule)
                yield batch.select([0, 1]).filter(pa.array(unequal(x, y) <= limit))

    found = materialise(pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(near, "a long, b long"), "ngram-near")
    release(sets, able, parts, met)
    return found


def unequal(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many parts each two sketches differ."""
    sizes = np.array([len(s) // 2 for s in x.to_pylist()], np.int64)
    one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint16) for c in (x, y))
    return np.add.reduceat((one != two).astype(np.int64), np.cumsum(sizes) - sizes)


def components_of(docs: DataFrame, index: DataFrame, rule: Rule) -> DataFrame:
    """(node, component) of the documents that link with another in a list of ``index``, as ENTRIES."""
    lists = index.groupBy("sig").agg(F.min(F.struct("own", "doc", "n", "reach")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(looked_up(index, materialise(lists, "ngram-lists"), ["sig"], "size", index.count()), "ngram-shared")
    spokes = shared.where((F.col("doc") != F.col("hub.doc")) & _may_link(F.col("n"), F.col("hub.n"), F.col("reach"), F.col("hub.reach"), rule))
    pairs = materialise(spokes.select(F.col("doc").alias("a"), F.col("hub.doc").alias("b")).distinct(), "ngram-pairs")
    links = _verified(docs, pairs, rule)
    named = components(links)

    rest = _rest(docs, shared, named, rule)
    release(shared)
    if rest is not None:
        named = components(links.union(rest))
    return named


def linked(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Null and empty texts and texts of white space have no shingles and link with
    nothing; a text of fewer words than the rule's width is one shingle. doc_ids
    are distinct: rows that repeat both doc_id and text get the same result. Rows
    without doc_id link with nothing and have a null component. Very long texts
    are sets like others; ties need no order, since a component is named by its
    smallest doc_id. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    sets = materialise(_sets(docs, rule), "ngram-tokens")
    known = sets.where("doc_id IS NOT NULL")
    index = materialise(_index(docs, known, rule), "ngram-index")

    named = components_of(docs, index, rule)
    release(index)
    classes = _classes(known).join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    classes = materialise(classes.select("sig_a", "sig_b", "low", "copies", F.coalesce("component", "doc_id").alias("name")), "ngram-classes")
    lowest = classes.groupBy("name").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("classes"))
    # very many classes may be one component, and very many rows one class
    classes = looked_up(classes, lowest, ["name"], "classes", classes.count()).select("sig_a", "sig_b", "copies", "component")
    rows = sets.select("doc_id", "n", "sig_a", "sig_b")
    out = looked_up(rows.where("n > 0"), classes, ["sig_a", "sig_b"], "copies", sets.count(), "left").select("doc_id", "n", "component")
    # texts without words are no class
    out = out.union(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long")))
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = materialise(out.select("doc_id", F.col("n").alias("n_shingles"), own.cast("long").alias("component_id")), "ngram-result")
    release(sets)
    return out


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] FOR i IN range(1, len(words) - 2)]) END AS grams FROM w
), n AS (
  SELECT doc_id, CAST(len(grams) AS BIGINT) AS n FROM s
), g AS (
  SELECT doc_id, md5_number(unnest(grams)) AS gram FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN ways e ON r.other = e.a
)
SELECT n.doc_id, n.n AS n_shingles, r.component_id FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
