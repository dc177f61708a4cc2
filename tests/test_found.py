"""A table of found spans serves the vault and the texts."""

import pytest

import veilspan as v
from checks import queries
from veilspan.operators import scrub, vault
from veilspan.operators.scrub import found_spans
from veilspan.operators.vault import vault_entries


def test_scrubbed_finds_its_spans_once(spark, monkeypatch):
    calls = []

    def counting(*args, **kwargs):
        calls.append(args)
        return original(*args, **kwargs)

    original = scrub.redactable
    for module in (scrub, vault):
        monkeypatch.setattr(module, "redactable", counting)
    queries._scrubbed(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_found_spans_give_the_same_vault_and_texts(spark):
    texts = spark.createDataFrame(
        [(1, "mail a@b.co or 10.0.0.1"), (2, "a​@b.co, 555-123-4567"), (3, "none"), (4, None)],
        "id int, text string",
    )
    found = found_spans(texts)
    entries = vault_entries(texts, found=found)
    assert sorted(entries.collect()) == sorted(vault_entries(texts).collect())
    made = v.build_vault(entries, "s")
    once = v.scrub_tokens(texts, secret="s", vault=made, found=found)
    assert sorted(once.collect(), key=str) == sorted(
        v.scrub_tokens(texts, secret="s", vault=made).collect(), key=str
    )
    with pytest.raises(ValueError, match="needs the vault"):
        v.scrub_tokens(texts, found=found)
