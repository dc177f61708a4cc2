"""Named entities as a second detector: a tagger supplied by the caller, BIO grouping,
locating the entities in the text."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.arrays import let, lookup
from veilspan.functions.patterns import NER_ENABLED, NER_TYPES
from veilspan.functions.text import not_blank, stripped
from veilspan.operators.detect import SPANS

# A tagger takes a list of texts and gives, for each, a list of
# (entity, word, score, idx) in text order.
Tagger = Callable[[list[str]], list[list[tuple]]]

TOKENS = "array<struct<entity:string,word:string,score:double,idx:int>>"
_TAGGED = f"struct<tokens:{TOKENS},error:string>"
_TRIM = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029]
        + [0x202F, 0x205F, 0x3000, 0xFEFF],
    )
)
_BATCH = 64
_loaded: dict[str, Tagger] = {}


def _load(payload: bytes) -> Tagger:
    """One load per Python worker, however many tasks it runs."""
    name = hashlib.sha256(payload).hexdigest()
    if name not in _loaded:
        _loaded[name] = cloudpickle.loads(payload)()
    return _loaded[name]


def _tag_batch(tagger: Tagger, texts: list[str]) -> list[tuple[list, str | None]]:
    """Tag a batch; if it fails, tag its texts one by one so that one text fails alone."""
    try:
        return [(_kept(tokens), None) for tokens in tagger(texts)]
    except Exception as error:
        if len(texts) == 1:
            return [([], f"{type(error).__name__}: {error}")]
        return [row for text in texts for row in _tag_batch(tagger, [text])]


def _kept(tokens: list[tuple]) -> list[dict]:
    return [
        {"entity": e, "word": w, "score": float(s), "idx": int(i)}
        for e, w, s, i in tokens
        if e != "O"
    ]


def tag_entities(
    df: DataFrame,
    tagger: Callable[[], Tagger],
    text: str = "text",
    strip: bool = True,
    tokens: str = "tokens",
    error: str = "ner_error",
) -> DataFrame:
    """Add the classifier's tokens (label ``O`` dropped in the worker) and its error, if any.

    ``tagger`` builds the classifier and runs once per Python worker. Null and blank texts
    never reach it. A text that fails gets no tokens and its error: silence would leak names.
    """
    payload = cloudpickle.dumps(tagger)

    @F.pandas_udf(_TAGGED)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = _load(payload)
        for batch in batches:
            texts = batch.tolist()
            rows: list = [([], None)] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(wanted), _BATCH):
                part = wanted[at : at + _BATCH]
                for i, row in zip(part, _tag_batch(run, [texts[j] for j in part]), strict=True):
                    rows[i] = row
            yield pd.DataFrame({"tokens": [r[0] for r in rows], "error": [r[1] for r in rows]})

    source = stripped(F.col(text)) if strip else F.col(text)
    work = df.withColumn(text, source)
    # Marked nondeterministic so that the optimizer never runs the classifier twice.
    result = tag.asNondeterministic()(F.when(not_blank(F.col(text)), F.col(text)))
    return (
        work.withColumn("_tagged", result)
        .withColumn(tokens, F.col("_tagged.tokens"))
        .withColumn(error, F.col("_tagged.error"))
        .drop("_tagged")
    )


def ner_tokens(
    df: DataFrame, keys: Sequence[str], tagger: Callable[[], Tagger], text: str = "text"
) -> DataFrame:
    """Token table ``keys, entity, word, score, idx``."""
    return tag_entities(df, tagger, text).select(*keys, F.inline("tokens"))


def ner_errors(tagged: DataFrame, keys: Sequence[str], error: str = "ner_error") -> DataFrame:
    """The texts the tagger failed on."""
    return tagged.filter(F.col(error).isNotNull()).select(*keys, error)


def drop_outside(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("entity") != "O")


def ner_type(entity: Column) -> Column:
    base = F.regexp_replace(entity, "^[BI]-", "")
    return lookup(NER_TYPES, base, F.lower(base))


def _glued(word: Column) -> Column:
    """A word piece as it is appended: ``##`` pieces join without a blank."""
    return F.when(word.startswith("##"), F.substring(word, F.lit(3), F.length(word))).otherwise(
        F.concat(F.lit(" "), word)
    )


def _opened(word: Column) -> Column:
    return F.regexp_replace(word, "^##", "")


def _extends(entity: Column, kind: Column, previous: Column) -> Column:
    return F.coalesce(entity.startswith("I-") & (kind == previous), F.lit(False))


def aggregate_entities(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """BIO grouping of a token table: ``keys, ord, type, value, score``.

    A run of ``I-`` tokens of the type before it belongs to what precedes it; a run counts when
    it opens with ``B-``. The score is the lowest in the run. One shuffle on the keys; a window
    holds the tokens of one text.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    typed = drop_outside(tokens).withColumn("type", ner_type(F.col("entity")))
    opens = ~_extends(F.col("entity"), F.col("type"), F.lag("type").over(order))
    marked = typed.withColumn("opens", opens).withColumn(
        "ord", F.sum(F.col("opens").cast("int")).over(order)
    )
    piece = F.when(F.col("opens"), _opened(F.col("word"))).otherwise(_glued(F.col("word")))
    return (
        marked.groupBy(*keys, "ord")
        .agg(
            F.min_by("type", "idx").alias("type"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("idx", piece.alias("piece")))),
                    lambda p: p["piece"],
                ),
                "",
            ).alias("value"),
            F.min("score").alias("score"),
            F.min_by("entity", "idx").alias("first"),
        )
        .filter(F.col("first").startswith("B-"))
        .select(*keys, F.col("ord").cast("int").alias("ord"), "type", "value", "score")
    )


def entities_of(tokens: Column) -> Column:
    """The same grouping inside a row: ``array<struct<type, value, score>>`` in text order."""

    def typed(t: Column) -> Column:
        return F.struct(
            t["entity"].alias("entity"),
            t["word"].alias("word"),
            t["score"].alias("score"),
            ner_type(t["entity"]).alias("type"),
        )

    def group(items: Column) -> Column:
        heads = F.filter(
            F.transform(
                items,
                lambda t, i: F.when(
                    ~_extends(t["entity"], t["type"], F.get(items, i - 1)["type"]), i
                ),
            ),
            lambda i: i.isNotNull(),
        )

        def runs(heads: Column) -> Column:
            def one(head: Column, j: Column) -> Column:
                stop = F.coalesce(F.get(heads, j + 1), F.size(items))
                first = F.get(items, head)
                rest = F.slice(items, head + 2, stop - head - 1)
                return F.struct(
                    first["entity"].alias("first"),
                    first["type"].alias("type"),
                    F.concat(
                        _opened(first["word"]),
                        F.array_join(F.transform(rest, lambda t: _glued(t["word"])), ""),
                    ).alias("value"),
                    F.array_min(
                        F.transform(F.slice(items, head + 1, stop - head), lambda t: t["score"])
                    ).alias("score"),
                )

            return F.transform(heads, one)

        return let(heads, runs)

    kept = F.transform(F.filter(tokens, lambda t: t["entity"] != "O"), typed)
    opened = F.filter(let(kept, group), lambda e: e["first"].startswith("B-"))
    return F.transform(
        opened,
        lambda e: F.struct(
            e["type"].alias("type"), e["value"].alias("value"), e["score"].alias("score")
        ),
    )


def _places(text: str, values: Sequence[str]) -> list[int | None]:
    """Start of each value's first occurrence that is clear of the values before it.

    After an occurrence that is not clear, the search goes on at its end. Taken spans only
    grow, so the search for a value never needs to go back behind its last stop.
    """
    starts: list[int] = []
    ends: list[int] = []
    resume: dict[str, int] = {}
    result: list[int | None] = []
    for value in values:
        word = (value or "").strip(_TRIM)
        at = text.find(word, resume.get(word, 0)) if word else -1
        while at >= 0:
            stop = at + len(word)
            i = bisect_right(ends, at)
            if i == len(starts) or starts[i] >= stop:
                starts.insert(i, at)
                ends.insert(i, stop)
                resume[word] = stop
                break
            resume[word] = stop
            at = text.find(word, stop)
        if word and at < 0:
            resume[word] = len(text)
        result.append(at if at >= 0 else None)
    return result


def _locate(texts: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if text is None or found is None else _places(text, list(found))
            for text, found in zip(texts, values, strict=True)
        ]
    )


def located(text: Column, entities: Column) -> Column:
    """Start of each entity of a row, or null. Each search depends on the one before it, so this runs in
    Arrow batches in Python; only the rows themselves are needed, nothing is shuffled."""
    locate = F.pandas_udf(_locate, "array<int>")
    return locate(text, F.transform(entities, lambda e: e["value"]))


def _spans_at(entities: Column, starts: Column) -> Column:
    spans = F.zip_with(
        entities,
        starts,
        lambda e, at: F.struct(
            e["type"].alias("type"),
            _trimmed(e["value"]).alias("value"),
            at.alias("start"),
            (at + F.length(_trimmed(e["value"]))).alias("end"),
        ),
    )
    return F.filter(spans, lambda s: s["start"].isNotNull())


def _trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(_TRIM))


def enabled(kind: Column, value: Column, types: Sequence[str] = NER_ENABLED) -> Column:
    """Enabled type, and at least two UTF-16 units long."""
    return kind.isin(*types) & (F.octet_length(F.encode(value, "UTF-16BE")) >= 4)


def entity_spans(
    df: DataFrame,
    tokens: str = "tokens",
    text: str = "text",
    types: Sequence[str] = NER_ENABLED,
    least: float | None = None,
    out: str = "extra",
) -> DataFrame:
    """Group, locate and filter the entities of each row: from token array to span array."""
    entities = entities_of(F.coalesce(F.col(tokens), F.array().cast(TOKENS)))
    if least is not None:
        entities = F.filter(entities, lambda e: e["score"] >= least)
    work = df.withColumn("_entities", entities)
    work = work.withColumn("_starts", located(F.col(text), F.col("_entities")))
    spans = F.filter(
        _spans_at(F.col("_entities"), F.col("_starts")),
        lambda s: enabled(s["type"], s["value"], types),
    )
    return work.withColumn(out, F.coalesce(spans, F.array()).cast(SPANS)).drop(
        "_entities", "_starts"
    )


def locate_entities(
    entities: DataFrame, df: DataFrame, keys: Sequence[str], text: str = "text"
) -> DataFrame:
    """Entity table to span table ``keys, ord, type, value, start, end``.

    Entities are gathered per text and join it on the keys; entities that occur nowhere clear
    of the earlier ones are dropped. ``text`` should be stripped already.
    """
    gathered = entities.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("ord", "type", "value"))).alias("_entities")
    )
    found = df.select(*keys, F.col(text).alias("_text")).join(gathered, [*keys])
    placed = found.withColumn("_starts", located(F.col("_text"), F.col("_entities")))
    rows = placed.select(
        *keys, F.inline(F.arrays_zip(F.col("_entities").alias("e"), F.col("_starts").alias("at")))
    )
    return rows.filter(F.col("at").isNotNull()).select(
        *keys,
        F.col("e.ord").alias("ord"),
        F.col("e.type").alias("type"),
        F.col("e.value").alias("value"),
        F.col("at").alias("start"),
        (F.col("at") + F.length(_trimmed(F.col("e.value")))).alias("end"),
    )


def filter_entities(spans: DataFrame, types: Sequence[str] = NER_ENABLED) -> DataFrame:
    """Runs after locating, so that an entity dropped here still held its place."""
    return spans.filter(enabled(F.col("type"), F.col("value"), types))


def min_score(entities: DataFrame, least: float | None = None) -> DataFrame:
    """Optional; the default keeps every score."""
    return entities if least is None else entities.filter(F.col("score") >= least)
