"""Write COVERAGE.md: SURVEY §2 ID → library function → registered queries → check."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.registry import load_all  # noqa: E402

# SURVEY §2 ID → library entry point(s)
FUNCTIONS = {
    "S1": "sources.tables.live", "S2": "sources.resources.read_json_map / read_timezones",
    "S3": "sources.files.crawl_files", "S4": "operators.catalog.build_country_dim",
    "S5": "sources.sinks.sitemap_rows", "S6": "sources.sinks.hreflang_rows", "S7": "sources.sinks.rss_items",
    "S8": "sources.sinks.to_envelope", "S9": "sources.sinks.to_xml_rows", "S10": "sources.sinks.wire_form",
    "P1": "operators.catalog.country_list", "P2": "operators.catalog.account_profile",
    "P3": "operators.catalog.entitlement", "P4": "operators.catalog.visible_to",
    "P5": "operators.catalog.mask_account / mask_file", "P6": "operators.usage.classify_probe",
    "P7": "operators.usage.parse_route", "P8": "operators.usage.guid_from_path", "P9": "operators.files.page, operators.paging.build_page_index / read_page",
    "P10": "operators.geo.clean_attempts", "P11": "operators.files.valid_uploads", "P12": "operators.files.acl_flags",
    "J1": "operators.catalog.location_detail", "J2": "operators.catalog.meta_rows",
    "J3": "operators.catalog.resolve_host", "J4": "operators.catalog.site_by_domain",
    "J5": "operators.catalog.with_meta_value", "J6": "operators.catalog.with_exists_flag",
    "J7": "operators.catalog.note_detail", "J8": "operators.catalog.session_profile",
    "J9": "operators.catalog.note_can_edit", "J10": "operators.catalog.file_can_edit",
    "J11": "operators.catalog.best_locale", "J12": "operators.catalog.match_account",
    "J13": "operators.catalog.url_conflicts", "J14": "operators.catalog.localise",
    "J15": "operators.content.overlay_labels", "J16": "operators.content.negotiate_locale",
    "J17": "operators.files.with_mime",
    "A1": "operators.usage.site_daily_stats", "A2": "operators.usage.client_top_k",
    "A3": "operators.catalog.pivot_meta", "A4": "operators.catalog.site_url_summary",
    "A5": "operators.content.nest_meta", "A6": "operators.content.melt_customer",
    "A7": "operators.files.quota_remaining", "A8": "operators.content.review_context",
    "W1": "operators.files.admit_uploads (+ operators.sequence.running_sum)",
    "O1": "operators.geo.random_location", "O2": "inside operators.catalog.resolve_host",
    "O3": "inside operators.usage.site_daily_stats",
    "M1": "operators.merge.merge_meta", "M2": "operators.merge.merge_notes (+ operators.sequence.next_in_sequence)",
    "M3": "operators.merge.apply_note_changes", "M4": "operators.merge.enforce_active_url",
    "M5": "operators.merge.soft_delete", "M6": "operators.merge.stamp_rows", "M7": "operators.merge.create_accounts",
    "M8": "operators.merge.update_accounts", "M9": "operators.merge.register_files",
    "M10": "operators.merge.intake_messages", "M11": "operators.merge.merge_sites",
    "M12": "operators.merge.issue_tokens / touch_tokens / revoke_tokens", "M13": "operators.usage.normalise_usage",
    "G1": "operators.geo.distance_km / with_distance_km", "G2": "operators.geo.score_attempts",
    "G3": "operators.images.exif_to_decimal", "G4": "functions.keys.encode_key / decode_key",
    "G5": "operators.images.photo_meta", "G6": "operators.files.plan_renditions", "G7": "sources.files.animated_gifs",
    "U1": "functions.useragent.parse_user_agent", "U2": "operators.usage.client_ip",
    "T1": "operators.text.clean_text", "T2": "operators.text.scrub_notes", "T3": "operators.text.plain_text",
    "T4": "operators.text.unique_words / word_index", "T5": "operators.text.keyword_tokens",
    "T6": "operators.text.clean_names", "T7": "operators.text.slugify / url_safe", "T8": "operators.text.clean_urls",
    "T9": "operators.text.url_identity / duplicate_urls", "T10": "operators.text.valid_hosts",
    "T11": "operators.text.valid_emails / text_direction", "T12": "operators.text.hashtags / hashtag_counts",
    "T13": "operators.text.footnotes", "T14": "operators.text.fold_whitespace / fill_template",
    "T15": "operators.text.norm_text / norm_number / parse_bool", "T16": "operators.text.licence_text",
    "D1": "operators.dates.api_dates", "D2": "operators.dates.convert_times", "D3": "operators.dates.age_buckets",
    "D4": "operators.dates.valid_date / hms_to_seconds / seconds_to_hms",
    "D5": "operators.dates.format_sizes / pad_ids",
    "X1": "streaming.jobs.usage_stream (+ streaming.log.TableLog)", "X2": "streaming.jobs.usage_daily_stream / usage_daily",
    "X3": "streaming.jobs.token_sessions_stream / token_sessions (+ operators.usage.sessionize)", "X4": "streaming.jobs.note_changes_stream / current_notes / note_history",
    "Q1": "operators.quality.check_rules", "Q2": "operators.quality.orphans_of_all / orphans", "Q3": "operators.quality.duplicates_of_all / duplicates",
    "Q4": "operators.quality.schema_drift",
}
UNIT_TESTED = {"S2": "tests/test_text_units.py (generated JSON files)",
               "G7": "tests/test_text_units.py (generated GIF files)"}


def main() -> None:
    reg = load_all()
    by_id: dict[str, list[str]] = {}
    for name, q in sorted(reg.items()):
        head = q.doc.split(":", 1)[0]
        for i in re.findall(r"\b([A-Z]\d{1,2})\b", head):
            by_id.setdefault(i, []).append(name)
    print("# Coverage of SURVEY §2\n")
    print("Generated by `tools/coverage.py` from the query registry. Check: **oracle** = independent DuckDB SQL")
    print("compared on row count, schema and values; **rows** = rows-only (reason in README); **unit** = tests only.\n")
    print("| ID | library function (`tessera.`) | registered queries | check |")
    print("|---|---|---|---|")
    for i, fn in FUNCTIONS.items():
        qs = by_id.get(i, [])
        if qs:
            kinds = {"oracle" if reg[q].oracle else "rows" for q in qs}
            check = " + ".join(sorted(kinds))
        else:
            check = "unit: " + UNIT_TESTED.get(i, "—")
        print(f"| {i} | `{fn}` | {', '.join(f'`{q}`' for q in qs) or '—'} | {check} |")


if __name__ == "__main__":
    main()
