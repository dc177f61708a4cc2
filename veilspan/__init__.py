"""Find, redact and restore personal data in text tables and streams with Spark."""

from veilspan.operators.detect import (
    candidate_spans,
    detect,
    detect_spans,
    detect_spans_cut,
    has_pii,
    valid_cards,
    valid_ipv4,
)
from veilspan.operators.entities import (
    aggregate_entities,
    drop_outside,
    entity_spans,
    filter_entities,
    locate_entities,
    min_score,
    ner_errors,
    ner_tokens,
    tag_entities,
)
from veilspan.operators.normalize import drop_blank, invisible_profile, strip_invisible
from veilspan.operators.redact import (
    label_mapping,
    redact,
    restore_labels,
    scrub_labels,
    scrub_with_mapping,
)
from veilspan.operators.restore import (
    extract_tokens,
    has_tokens,
    restore_tokens,
    round_trip_check,
    unresolved_tokens,
)
from veilspan.operators.scrub import IncompleteVault, scrub_tokens
from veilspan.operators.spans import (
    cover_spans,
    merge_span_tables,
    merge_spans,
    sort_spans,
    span_overlaps,
    span_pairs,
)
from veilspan.operators.summary import (
    pii_report,
    pii_summary,
    summarize_spans,
    summary_with_source,
)
from veilspan.operators.vault import build_vault, span_entries, vault_collisions, vault_entries
from veilspan.plans.scrub import (
    scrub_to_vault,
    scrub_with_ner,
    scrub_with_ner_to_vault,
    with_entities,
)
from veilspan.sources.texts import read_texts, stream_texts, write_scrubbed
from veilspan.sources.vaults import NoMapping, compact_vault, load_vault, save_vault
from veilspan.streaming.streams import (
    restore_stream,
    restore_waiting_stream,
    scrub_stream,
    scrub_token_stream,
    summary_stream,
    vault_stream,
)

__all__ = [name for name in dir() if not name.startswith("_")]
