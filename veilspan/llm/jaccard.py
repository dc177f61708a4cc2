"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles, as 64-bit hashes. All tokens have one global
order: rare ones first, then frequent ones, by hash within both. Two sets that are similar enough
share all but a few tokens, so their prefixes in this order share some. A rare token of a prefix
is indexed on its own. Frequent tokens are dealt into groups, and pairs of a group's tokens are
indexed, because a single one would bring everything together that holds it. A token of a group
with c tokens in the prefix counts for c - 1: the prefix is extended until rare tokens and groups
count for more than the tokens that a similar set may lack, so two similar sets share a rare token
or a pair. The smaller one of two sets may lack fewer tokens of the other, so it needs a shorter
prefix: an entry that is of no set's shorter prefix brings nothing together. Verification is exact.

Documents with the same set are one node. No list of an index entry is expanded into its pairs:
first its members are compared with one leader, the member with the most frequent tokens. Only
members that the links so far do not join are compared with each other, in blocks and each two
blocks once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Words, cut_lineage, discard, mix, ship, slices
from veilspan.llm.components import components

#: A token in more prefixes than this is frequent. At most ``MOST`` tokens are, the most frequent
#: ones: their broadcast is bounded by 8 bytes each. Which ones are never changes the result.
FREQUENT, MOST = 48, 1 << 18
#: Members of a leader that are verified together, and nodes of a block.
BLOCK = 256
#: Bits by which texts are chosen before they are sent; their broadcast is at most 2^18 words.
SLOTS = 1 << 24

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def token_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words, or all words if fewer."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        words = Words(texts[a:b], ~_BLANK)
        hashes, n = words.hashes(), len(words.start)
        rolled = np.zeros(n, dtype=_U)
        for k in range(min(width, n)):
            rolled[: n - k] = mix(rolled[: n - k] * _U(0x9E3779B97F4A7C15) + hashes[k:])
        for i in range(b - a):
            lo, hi = words.first[i], words.first[i + 1]
            if hi - lo >= width:
                out.append(np.unique(rolled[lo : hi - width + 1]))
            elif hi > lo:
                short = hashlib.blake2b(hashes[lo:hi].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(short, dtype=_U))
            else:
                out.append(np.empty(0, dtype=_U))
    return out


def _least(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with one that is similar enough."""
    return -(-percent * n // 100)


def _bands(n: int, percent: int) -> set[int]:
    """Size classes in which a set of n meets its partners: by the smaller one of two sizes."""
    return {n.bit_length(), max(1, _least(n, percent)).bit_length()}


def possible(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    """Whether sets of nx and ny tokens can be similar, given the tokens of least hash of both.

    Up to the smaller of the two last hashes both sets are known, and so is what each lacks there.
    """
    if not len(x) or not len(y):
        return False
    upto = min(x[-1], y[-1])
    x, y = x[x <= upto], y[y <= upto]
    both = len(np.intersect1d(x, y, assume_unique=True))
    least = -(-percent * (nx + ny) // (100 + percent))
    return len(x) - both <= nx - least and len(y) - both <= ny - least


def index_entries(
    tokens: np.ndarray, frequent: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, float]:
    """Index entries of a set: those by which it meets sets of its size or larger ones, and further
    ones by which only smaller sets meet it; and the share of its tokens that are frequent.

    A set may lack fewer tokens of a larger one than of a smaller one, so the first are of a
    shorter prefix. Two similar sets have one of the smaller set's first entries in common.
    """
    n = len(tokens)
    need, short = n - _least(n, percent) + 1, n + 1 + -(2 * percent * n) // (100 + percent)
    at = np.searchsorted(frequent, tokens)
    often = frequent[np.minimum(at, len(frequent) - 1)] == tokens if len(frequent) else np.zeros(n, bool)
    rare, share = tokens[~often][:need], float(often.mean()) if n else 0.0
    if len(rare) >= need:
        return rare[:short], rare[short:], share
    found, later, hot = [rare[:short]], [rare[short:]], tokens[often]
    scattered = mix(hot ^ _U(0xA5A5A5A5A5A5A5A5))
    for band in _bands(n, percent):
        groups = max(1, (1 << band) // 32)
        group = (scattered % _U(groups)).astype(np.int64)
        counts = np.ones(len(hot), dtype=np.int64)
        counts[np.unique(group, return_index=True)[1]] = 0
        reached = np.cumsum(counts)
        upto = int(np.searchsorted(reached, need - len(rare))) + 1
        # The smaller one of two sets is met in its own band.
        own = band == n.bit_length() and len(rare) < short
        first = int(np.searchsorted(reached, short - len(rare))) + 1 if own else 0
        place = np.argsort(group[:upto], kind="stable")
        for part in np.split(place, np.flatnonzero(np.diff(group[place])) + 1):
            i, j = (part[x] for x in np.triu_indices(len(part), 1))
            pairs = mix(mix(hot[i] * _U(3)) ^ (hot[j] + _U(band)))
            found.append(pairs[np.maximum(i, j) < first])
            later.append(pairs[np.maximum(i, j) >= first])
    lead = np.unique(np.concatenate(found))
    return lead, np.setdiff1d(np.concatenate(later), lead), share


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, float]:
    """All index entries of a set, and the share of its tokens that are frequent."""
    lead, later, share = index_entries(tokens, frequent, percent)
    return np.concatenate([lead, later]), share


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not len(x):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _texts(batch: pd.DataFrame) -> list[bytes]:
    return [t.encode() for t in batch["text_"]]


def _frequent_tokens(rows: DataFrame, width: int, percent: int) -> np.ndarray:
    """Tokens that many prefixes hold, counted over all documents (by the order of the hash)."""

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for tokens in token_sets(_texts(batch), width):
                need = len(tokens) - _least(len(tokens), percent) + 1
                kept.append(tokens[: need + need // 2 + 2])
            token, n = np.unique(np.concatenate(kept or [np.empty(0, _U)]), return_counts=True)
            yield pd.DataFrame({"token": token.view(np.int64), "n": n})

    counted = rows.select("text_").mapInPandas(prefixes, "token long, n long")
    often = counted.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT)
    most = often.orderBy(F.desc("n"), "token").limit(MOST).select("token")
    return np.sort(np.array([r[0] for r in most.collect()], dtype=np.int64).view(_U))


def _described(rows: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """Per document: id_, n, digest of its set, and rank (of a leader) and entries for the index,
    of which the first ``lead`` ones meet sets of its size or larger ones.

    ``sample`` has the tokens of least hash, as many as a prefix; null where the entries are these.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = token_sets(_texts(batch), width)
            found = [index_entries(s, frequent.value, percent) for s in sets]
            entries = [np.concatenate(f[:2]) for f in found]
            samples = []
            for tokens, own in zip(sets, entries, strict=True):
                first = tokens[: len(tokens) - _least(len(tokens), percent) + 1]
                same = np.array_equal(first, own)
                samples.append(None if same else first.view(np.int64))
            yield pd.DataFrame(
                {
                    "id_": batch["id_"].astype("Int64"),
                    "n": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "rank": [int(-1000 * f[2]) for f in found],
                    "entries": [e.view(np.int64) for e in entries],
                    "lead": [len(f[0]) for f in found],
                    "sample": pd.Series(samples, dtype=object),
                }
            )

    schema = "id_ long, n long, digest binary, rank int, entries array<long>, lead int, sample array<long>"
    return rows.mapInPandas(describe, schema)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose samples do not rule out that their sets are similar enough."""
    held = nodes.select("node", "n", F.coalesce("sample", "entries").alias("s"))
    x = held.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    y = held.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [
                possible(np.asarray(sa, np.int64).view(_U), na, np.asarray(sb, np.int64).view(_U), nb, percent)
                for sa, na, sb, nb in zip(batch["sa"], batch["na"], batch["sb"], batch["nb"], strict=True)
            ]
            yield batch.loc[np.array(fits, dtype=bool), ["a", "b"]]

    together = pairs.join(x, "a").join(y, "b")
    return cut_lineage(together.mapInPandas(keep, "a long, b long").distinct())


def _texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows that have one of the ids (id_), written.

    Ids are too many to broadcast, and a join would send all texts for the few that are wanted: so
    a bit for each id's hash is broadcast first, and only rows whose bit is set go to the join.
    """
    ids = cut_lineage(ids.distinct())
    slot = F.pmod(F.xxhash64("id_"), F.lit(SLOTS)).alias("slot")
    word, bit = F.expr("shiftright(slot, 6)"), F.expr("shiftleft(1L, CAST(slot & 63L AS INT))")
    words = ids.select(slot).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    hashed = rows.select("*", slot).withColumn("word", word).withColumn("bit", bit)
    fits = (F.col("h.word") == F.col("w.word")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0)
    few = hashed.alias("h").join(F.broadcast(words.alias("w")), fits, "left_semi")
    texts = cut_lineage(few.select(*rows.columns).join(ids, "id_", "left_semi"))
    discard(ids)
    return texts


def _verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    texts = _texts_of(rows, pairs.select(F.col("a").alias("id_")).union(pairs.select("b")))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes)
    dealt = cut_lineage(pairs.join(sizes, "a").select("a", "b", block))
    members = dealt.withColumnRenamed("b", "id_").join(texts, "id_").select(
        "a", "block", F.lit(1).alias("member"), "id_", "text_"
    )
    leaders = dealt.select("a", "block").distinct().join(
        texts.withColumnRenamed("id_", "a"), "a"
    ).select("a", "block", F.lit(0).alias("member"), F.col("a").alias("id_"), "text_")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own = None, []
        for batch in batches:
            out = []
            sets = token_sets(_texts(batch), width)
            for a, blk, member, b, tokens in zip(
                batch["a"], batch["block"], batch["member"], batch["id_"], sets, strict=True
            ):
                if (a, blk) != current:
                    current, own = (a, blk), []
                if not member:
                    own.append(tokens)
                elif any(similar(x, tokens, percent) for x in own):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    near = members.unionByName(leaders).repartition("a", "block")
    near = near.sortWithinPartitions("a", "block", "member")
    links = cut_lineage(near.mapInPandas(compare, "a long, b long").distinct())
    discard(texts, sizes, dealt)
    return links


def _joined_blocks(
    lists: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links (a, b) that join all members of a list which are similar enough, given lists
    (entry, node, size, label, leads, leader) of nodes and the components they are in.

    Nodes are put into blocks of at most about ``BLOCK``, by the smallest of their lists' leaders,
    which brings most of what shares lists together, and by bands of size, of which only
    neighbours can be similar. Two blocks meet once if they have a list in
    common, whatever number of lists that is. A task counts the common tokens of two blocks as a
    product of matrices: first those of the samples, which rule most nodes out, then those of the
    whole sets of what is left. It answers with no more links than it has nodes.
    """
    band = F.floor(F.log("size") / float(1.000001 * np.log(100 / percent))).cast("int")
    family = lists.groupBy("node", "size", "label").agg(F.min("leader").alias("family"))
    family = family.withColumn("band", band)
    sizes = cut_lineage(family.groupBy("family", "band").agg(F.count(F.lit(1)).alias("n")))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))
    blocks = cut_lineage(
        family.join(sizes, ["family", "band"]).select(
            "node", "label", "band", F.xxhash64("family", "band", part).alias("block")
        )
    )
    met = lists.join(blocks.select("node", "block", "band"), "node")
    met = cut_lineage(
        met.groupBy("entry", "block", "band").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.max("leads").alias("leads")
        )
    )
    x, y = (met.select("entry", *[F.col(c).alias(c + k) for c in met.columns[1:]]) for k in "xy")
    # Blocks that are of one and the same component have nothing to say to each other.
    differ = (F.col("lowx") != F.col("highy")) | (F.col("highx") != F.col("lowy"))
    near = (F.col("blockx") <= F.col("blocky")) & (F.abs(F.col("bandx") - F.col("bandy")) <= 1)
    # The smaller set has the entry among its first ones.
    first = (F.col("leadsx") & (F.col("bandx") <= F.col("bandy"))) | (
        F.col("leadsy") & (F.col("bandy") <= F.col("bandx"))
    )
    pairs = cut_lineage(
        x.join(y, "entry")
        .filter(near & differ & first)
        .select(F.col("blockx").alias("x"), F.col("blocky").alias("y"))
        .distinct()
    )
    sides = pairs.select("x", "y", F.lit(0).alias("side"), F.col("x").alias("block")).unionByName(
        pairs.filter("x < y").select("x", "y", F.lit(1).alias("side"), F.col("y").alias("block"))
    )
    # A tenth of a set's tokens, by their upper 32 bits: more than a similar set may lack. Tokens
    # that coincide there only make it rule out less.
    least = F.slice(F.coalesce("sample", "entries"), F.lit(1), (F.col("n") / 10).cast("int") + 2)
    upper = F.transform(least, lambda x: F.shiftright(x, 32).cast("int"))
    samples = blocks.join(nodes.select("node", "n", upper.alias("sample")), "node").select(
        "block", "node", "label", "n", "sample"
    )

    def rule_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def prepared(batch: pd.DataFrame) -> pd.DataFrame:
            upper = [np.asarray(v, np.int32).view(np.uint32) for v in batch["sample"]]
            return batch.assign(tokens=[np.unique(v) for v in upper])

        columns = ["x", "y", "side", "node", "label", "n", "tokens"]
        for found in _groups(map(prepared, batches), columns):
            yield pd.DataFrame(
                [r[:5] for left, right in found for r in _not_ruled_out(left, right, percent)],
                columns=columns[:5],
            )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def prepared(batch: pd.DataFrame) -> pd.DataFrame:
            return batch.assign(tokens=token_sets(_texts(batch), width))

        for found in _groups(map(prepared, batches), ["x", "y", "side", "node", "label", "tokens"]):
            out = []
            for left, right in found:
                root = {r[4]: r[4] for r in left + right}
                for i, j in similar_rows([r[5] for r in left], [r[5] for r in right], percent):
                    a, b = _root(root, left[i][4]), _root(root, right[j][4])
                    if a != b:
                        root[a] = b
                        out.append((left[i][3], right[j][3]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("x", "y").sortWithinPartitions("x", "y", "side")

    schema = "x long, y long, side int, node long, label long"
    left = cut_lineage(dealt(sides.join(samples, "block")).mapInPandas(rule_out, schema))
    texts = _texts_of(rows, left.select(F.col("node").alias("id_")))
    together = left.join(texts.withColumnRenamed("id_", "node"), "node")
    links = dealt(together).mapInPandas(compare, "a long, b long")
    links = cut_lineage(links.distinct())
    discard(sizes, blocks, met, pairs, left, texts)
    return links


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple[list, list]]]:
    """The rows of each two blocks, as those of side 0 and of side 1 (of side 0 again where a
    block meets itself), from batches sorted by blocks; for each batch those that end in it."""
    current, rows = None, []

    def sides() -> tuple[list, list]:
        left = [r for r in rows if r[2] == 0]
        right = [r for r in rows if r[2] == 1]
        return left, right or (left if current[0] == current[1] else [])

    for batch in batches:
        done = []
        for row in zip(*[batch[c].tolist() if c != "tokens" else batch[c] for c in columns], strict=True):
            if row[:2] != current:
                if rows:
                    done.append(sides())
                current, rows = row[:2], []
            rows.append(row)
        yield [g for g in done if g[0] and g[1]]
    if rows and all(last := sides()):
        yield [last]


def _not_ruled_out(left: list, right: list, percent: int) -> list:
    """Rows (.., label, n, sample) of both sides that may be similar to one of the other side and
    of another component."""
    if len(left) * len(right) <= 256:
        pairs = [
            (i, j)
            for i, x in enumerate(left)
            for j, y in enumerate(right)
            if x[4] != y[4]
            and min(x[5], y[5]) * 100 >= percent * max(x[5], y[5])
            and possible(x[6], x[5], y[6], y[5], percent)
        ]
        keep_left, keep_right = {i for i, _ in pairs}, {j for _, j in pairs}
    else:
        sx, sy = [r[6] for r in left], [r[6] for r in right]
        nx, ny = np.array([r[5] for r in left])[:, None], np.array([r[5] for r in right])[None, :]
        least = -(-percent * (nx + ny) // (100 + percent))
        fits = np.minimum(nx, ny) * 100 >= percent * np.maximum(nx, ny)
        fits &= np.array([r[4] for r in left])[:, None] != np.array([r[4] for r in right])[None, :]
        # The sample that ends first is known in the other set: what it lacks there is lacking.
        lx, ly = (np.array([v[-1] for v in vs], dtype=_U) for vs in (sx, sy))
        px, py = (np.array([len(v) for v in vs]) for vs in (sx, sy))
        first = lx[:, None] <= ly[None, :]
        lacking = np.where(first, px[:, None], py[None, :]) - common_counts(sx, sy)
        fits &= lacking <= np.where(first, nx, ny) - least
        keep_left, keep_right = set(np.flatnonzero(fits.any(axis=1))), set(np.flatnonzero(fits.any(axis=0)))
    if right is left:
        return [left[i] for i in sorted(keep_left | keep_right)]
    return [left[i] for i in sorted(keep_left)] + [right[j] for j in sorted(keep_right)]


def _root(root: dict, x):
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each set of one list with each of another, as a product of matrices over
    the tokens that both lists have."""
    x, y = np.concatenate(xs), np.concatenate(ys)
    rx = np.repeat(np.arange(len(xs)), [len(s) for s in xs])
    ry = np.repeat(np.arange(len(ys)), [len(s) for s in ys])
    common = np.intersect1d(x, y)
    both = np.zeros((len(xs), len(ys)), dtype=np.float32)
    for at in range(0, len(common), 4096):
        columns = common[at : at + 4096]
        both += _marked(x, rx, len(xs), columns) @ _marked(y, ry, len(ys), columns).T
    return both


def similar_rows(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Places of the similar pairs of two lists of sets."""
    nx, ny = (np.array([len(s) for s in sets], dtype=np.int64) for sets in (xs, ys))
    both = common_counts(xs, ys)
    all_of = nx[:, None] + ny[None, :] - both
    for i, j in np.argwhere((100 * both >= percent * all_of) & (both > 0)):
        yield int(i), int(j)


def _marked(tokens: np.ndarray, rows: np.ndarray, n: int, columns: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(columns, tokens), len(columns) - 1)
    held = columns[at] == tokens
    out = np.zeros((n, len(columns)), dtype=np.float32)
    out[rows[held], at[held]] = 1.0
    return out


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id.

    Two documents link if their sets of ``width``-word shingles have a Jaccard similarity of
    ``percent`` or more; component_id is the smallest id that links lead to. Null, empty and blank
    texts have no shingles and link with nothing. A null id links with nothing and has a null
    component. Rows that repeat an id are one document: it links if one of its texts does. An
    empty table gives no rows. Shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text_")
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), text)
    frequent = spark.sparkContext.broadcast(_frequent_tokens(rows, width, percent))
    described = cut_lineage(_described(rows, frequent, width, percent))
    sets = described.filter("n > 0 AND id_ IS NOT NULL")
    nodes = cut_lineage(
        sets.groupBy("n", "digest").agg(
            F.min("id_").alias("node"),
            F.first("rank").alias("rank"),
            F.first("entries").alias("entries"),
            F.first("lead").alias("lead"),
            F.first("sample").alias("sample"),
        )
    )
    documents = cut_lineage(described.select("id_", "n", "digest"))
    discard(described)

    # Most entries are of one set only: they are counted by themselves, before the rest is sent.
    postings = nodes.select("lead", F.posexplode("entries").alias("pos", "entry"))
    counted = postings.groupBy("entry").agg(
        F.count(F.lit(1)).alias("times"), F.max(F.col("pos") < F.col("lead")).alias("leads")
    )
    shared = cut_lineage(counted.filter("times > 1 AND leads").select("entry"))
    members = nodes.select(
        "node", F.col("n").alias("size"), "rank", "lead", F.posexplode("entries").alias("pos", "entry")
    )
    members = members.withColumn("leads", F.col("pos") < F.col("lead")).drop("pos", "lead")
    members = cut_lineage(members.join(shared, "entry"))
    leader = F.min(F.struct("rank", "node", "size")).alias("leader")
    leaders = cut_lineage(members.groupBy("entry").agg(leader))
    lists = cut_lineage(members.drop("rank").join(leaders, "entry"))
    discard(shared, members, leaders)
    near = F.least("size", "leader.size") * 100 >= F.greatest("size", "leader.size") * percent
    led = cut_lineage(
        lists.filter((F.col("leader.node") != F.col("node")) & near)
        .select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    fitting = _possible(led, nodes, percent)
    links = _verified(fitting, rows, width, percent)
    discard(led, fitting)
    labels = components(links)

    # Lists whose members the links so far do not join.
    named = labels.select(F.col("id").alias("node"), "label")
    placed = lists.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = (
        placed.groupBy("entry")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low <> high")
        .select("entry")
    )
    apart = cut_lineage(apart)
    open_lists = cut_lineage(
        placed.join(apart, "entry").select(
            "entry", "node", "size", "label", "leads", F.col("leader.node").alias("leader")
        )
    )
    discard(lists, apart)
    more = _joined_blocks(open_lists, nodes, rows, width, percent)
    discard(open_lists)
    if not more.isEmpty():
        joined = cut_lineage(links.union(more))
        discard(labels)
        labels = components(joined)
        discard(joined)

    named = labels.select(F.col("id").alias("node"), F.col("label").alias("component"))
    of_set = cut_lineage(
        nodes.select("n", "digest", "node")
        .join(named, "node", "left")
        .select("n", "digest", F.coalesce("component", "node").alias("component"))
    )
    discard(nodes, links, more, labels)
    found = documents.join(of_set, ["n", "digest"], "left")
    component = F.when(F.col("id_").isNotNull(), F.coalesce("component", "id_"))
    return found.select(
        F.col("id_").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")
    )
