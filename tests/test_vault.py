import pytest
from pyspark.sql import functions as F

import veilspan as v
from veilspan.operators import vault as vaults
from veilspan.operators.vault import VAULT_SCHEMA, vault_entries
from veilspan.plans.scrub import scrub_to_vault
from veilspan.sources.vaults import NoMapping, load_vault, save_vault


def entries(spark, values, entity="email", session="default"):
    return spark.createDataFrame([(session, entity, x) for x in values], "session string, entity string, value string")


def clash(monkeypatch, digits):
    """Shorter hashes, padded back to the token format, so that collisions are common."""
    real = vaults.token_of

    def short(*args):
        token = real(*args)
        return F.concat(F.left(token, F.length(token) - (9 - digits)), F.lit("0" * (8 - digits) + "]"))

    monkeypatch.setattr(vaults, "token_of", short)


def test_collisions_are_repaired_and_deterministic(spark, monkeypatch):
    clash(monkeypatch, 2)
    values = [f"u{i}@x.co" for i in range(200)]
    one = v.build_vault(entries(spark, values).repartition(1))
    two = v.build_vault(entries(spark, values[::-1] * 2).repartition(7))
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, two.collect()))
    assert len({r[3] for r in rows}) == len(rows) == 200
    assert max(r[4] for r in rows) > 0
    assert v.vault_collisions(one).isEmpty()


def test_existing_rows_keep_their_token(spark, monkeypatch):
    clash(monkeypatch, 2)
    old = v.build_vault(entries(spark, [f"u{i}@x.co" for i in range(100, 200)]))
    new = v.build_vault(entries(spark, [f"u{i}@x.co" for i in range(180)]), existing=old)
    assert new.count() == 100
    both = old.unionByName(new)
    assert both.select("token").distinct().count() == both.count() == 200


def test_full_token_space_is_reported(spark, monkeypatch):
    clash(monkeypatch, 0)
    monkeypatch.setattr(vaults, "_MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="token space"):
        v.build_vault(entries(spark, ["a", "b"]))


def test_repaired_tokens_come_from_the_vault(spark, texts, monkeypatch):
    clash(monkeypatch, 2)
    rows = [f"write to u{i}@x.co and u{i % 7}@x.co or 1.2.3.{i % 256}" for i in range(200)] + ["none", None]
    df = texts(rows)
    vault = v.build_vault(vault_entries(df))
    assert not vault.filter("attempt > 0").isEmpty()
    want = dict(enumerate(rows, 1))
    twice = vault.unionByName(vault)  # as two writers leave it
    for kept in (vault, twice):
        scrubbed = v.scrub_tokens(df, vault=kept, hot_rows=3)
        assert dict(v.restore_tokens(scrubbed, vault).collect()) == want


def test_a_value_that_the_vault_lacks_is_an_error(spark, texts):
    vault = v.build_vault(entries(spark, ["a@x.co"]))
    with pytest.raises(v.IncompleteVault, match="lacks"):
        v.scrub_tokens(texts(["a@x.co", "b@x.co"]), vault=vault)
    other = vault.withColumn("token", F.lit("[REDACTED_EMAIL_00000000]"))
    with pytest.raises(v.IncompleteVault, match="two tokens"):
        v.scrub_tokens(texts(["a@x.co"]), vault=vault.unionByName(other))
    scrubbed = v.scrub_tokens(texts(["to a@x.co"]), vault=other)
    assert scrubbed.first().text == "to [REDACTED_EMAIL_00000000]"


def test_no_value_of_a_text_enters_a_plan(spark, texts, monkeypatch):
    clash(monkeypatch, 2)
    df = texts([f"hidden{i}@x.co" for i in range(40)])
    vault = v.build_vault(vault_entries(df))
    plan = v.scrub_tokens(df, vault=vault)._jdf.queryExecution().toString()
    assert "hidden" not in plan and "REDACTED_EMAIL_0" not in plan


def test_sessions_must_not_be_null(spark, texts):
    df = texts(["a@b.co", "nothing"])
    null = F.when(F.col("id") > 5, F.lit("s"))
    for work in (vault_entries(df, null), v.scrub_tokens(df, null)):
        with pytest.raises(Exception, match="must not be null"):
            work.collect()


def test_entries_of_a_span_table_take_names_and_expressions(spark, texts):
    spans = v.detect_spans(texts(["a@b.co", "c@d.co"]), ["id"])
    by_row = vaults.span_entries(spans, F.concat(F.lit("s"), F.col("id")))
    assert {r.session for r in by_row.collect()} == {"s1", "s2"}
    assert {r.session for r in vaults.span_entries(spans, "session").collect()} == {"session"}


def test_sessions_and_secrets_change_tokens(spark, texts):
    df = texts(["a@b.co", "a@b.co"])
    first = v.scrub_tokens(df).select("text").distinct().collect()
    assert len(first) == 1
    assert v.scrub_tokens(df, session="other").first().text != first[0].text
    assert v.scrub_tokens(df, secret="s").first().text != first[0].text
    by_row = v.scrub_tokens(df, session=F.concat(F.lit("s"), F.col("id")))
    assert by_row.select("text").distinct().count() == 2


def test_store(spark, tmp_path):
    path = str(tmp_path / "vault")
    assert load_vault(spark, path).count() == 0
    with pytest.raises(NoMapping):
        load_vault(spark, path, require_mapping=True)
    vault = v.build_vault(entries(spark, ["a@b.co", "c@d.co"]))
    save_vault(vault, path)
    save_vault(vault, path)
    assert load_vault(spark, path).count() == 2
    save_vault(v.build_vault(entries(spark, ["e@f.co"])), path)
    assert load_vault(spark, path).count() == 3
    save_vault(load_vault(spark, path).filter("value = 'e@f.co'"), path, "overwrite")
    assert [r.value for r in load_vault(spark, path, True).collect()] == ["e@f.co"]
    with pytest.raises(ValueError):
        save_vault(vault, path, "other")
    with pytest.raises(NoMapping):
        load_vault(spark, path, True, session="another")


def test_scrub_to_vault_twice(spark, texts, tmp_path):
    path = str(tmp_path / "vault")
    one = dict(scrub_to_vault(texts(["a@b.co 1.2.3.4"]), path, secret="s").collect())
    two = dict(scrub_to_vault(texts(["x", "a@b.co e@f.co"]), path, secret="s").collect())
    assert one[1].split()[0] == two[2].split()[0]
    assert load_vault(spark, path).count() == 3


def restore(spark, text, rows, **kw):
    vault = spark.createDataFrame([("default", "x", value, token, 0, 1) for token, value in rows], VAULT_SCHEMA)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return v.restore_tokens(df, vault, **kw).first().text, v.unresolved_tokens(df, vault, ["id"])


def test_restore_vectors(spark):
    a, b = "[REDACTED_EMAIL_abc12def]", "[REDACTED_IP_00000000]"
    got, left = restore(spark, f"{a} and {b}{a}", [(a, "a$1\\b@c.co")])
    assert got == f"a$1\\b@c.co and {b}a$1\\b@c.co"
    assert [tuple(r) for r in left.collect()] == [(1, "default", b, 1, "unknown")]
    assert restore(spark, "x [REDACTED_deadbeef]", [("[REDACTED_deadbeef]", a), (a, "no")])[0] == f"x {a}"
    got, left = restore(spark, f"{a}{a}", [(a, "one"), (a, "two")])
    assert got == f"{a}{a}"
    assert [tuple(r) for r in left.collect()] == [(1, "default", a, 2, "ambiguous")]
    assert restore(spark, f"{a}!", [(a, "one"), (a, "one")])[0] == "one!"
    assert restore(spark, "[REDACTED_email_abc12def] [REDACTED_EMAIL_ABC12DEF]", [(a, "x")])[0].startswith("[REDACTED_email")


def test_restore_with_an_empty_vault_changes_nothing(spark, texts):
    df = v.scrub_tokens(texts(["a@b.co", "x", None, "a@b.co 1.2.3.4"]))
    empty = spark.createDataFrame([], VAULT_SCHEMA)
    assert dict(v.restore_tokens(df, empty).collect()) == dict(df.collect())


def test_copies_without_unique_keys_are_all_restored(spark):
    df = spark.createDataFrame([(1, "mail a@b.co")] * 500 + [(1, "c@d.co")] * 3, "id int, text string")
    vault = v.build_vault(vault_entries(df))
    scrubbed = v.scrub_tokens(df, vault=vault)
    for hot_rows in (1_000_000, 10):
        back = v.restore_tokens(scrubbed, vault, hot_rows=hot_rows)
        assert sorted(map(tuple, back.groupBy("text").count().collect())) == [("c@d.co", 3), ("mail a@b.co", 500)]


def test_extract(spark, texts):
    a = "[REDACTED_EMAIL_abc12def]"
    rows = v.extract_tokens(texts([f"é{a}{a} x", "none", None, "[REDACTED_00000000]"]), ["id"]).collect()
    assert sorted(map(tuple, rows)) == [
        (1, 0, a, 1, 26), (1, 1, a, 26, 51), (4, 0, "[REDACTED_00000000]", 0, 19),
    ]


def test_round_trips_with_null_and_repeated_keys(spark):
    def table(rows):
        return spark.createDataFrame(rows, "id int, text string")

    original = table([(None, "a"), (1, None), (2, "b"), (2, "b"), (2, "c"), (3, "d"), (4, "e")])
    restored = table([(None, "a"), (2, "c"), (2, "b"), (2, "b"), (3, "x"), (4, "e"), (4, "e")])
    assert v.round_trip_check(original, original, ["id"]).isEmpty()
    assert sorted(r.id for r in v.round_trip_check(original, restored, ["id"]).collect()) == [1, 3, 4]
