"""Schemas of the tables."""

EVENTS = ("session_id STRING, seq LONG, ts TIMESTAMP, type STRING, turn INT, text STRING, source_kind STRING, "
          "call_id STRING, tool STRING, arguments STRING, is_error BOOLEAN, error_name STRING, error_code STRING, "
          "cwd STRING")

TURNS = "session_id STRING, turn INT, user STRING, assistant STRING, tools ARRAY<STRING>, files ARRAY<STRING>"

EPISODES = ("id STRING, ts TIMESTAMP, session_id STRING, scope STRING, partition STRING, cwd STRING, title STRING, "
            "summary STRING, decisions ARRAY<STRING>, todos ARRAY<STRING>, files ARRAY<STRING>, tags ARRAY<STRING>, "
            "source STRING")

FACTS = ("id STRING, ts TIMESTAMP, updated_at TIMESTAMP, scope STRING, partition STRING, kind STRING, key STRING, "
         "text STRING, hits LONG, sources ARRAY<STRING>, tags ARRAY<STRING>, superseded_by STRING, "
         "superseded_at TIMESTAMP")

STACK = ("STRUCT<ecosystem: STRING, languages: ARRAY<STRING>, frameworks: ARRAY<STRING>, "
         "framework_versions: MAP<STRING,STRING>, version_constraints: MAP<STRING,STRING>, "
         "versions: MAP<STRING,STRING>, sdks: ARRAY<STRUCT<name: STRING, version: STRING>>, build_tool: STRING>")

API = "ARRAY<STRUCT<symbol: STRING, signature: STRING, notes: STRING>>"
EXAMPLE = "STRUCT<language: STRING, kind: STRING, code: STRING>"
EVIDENCE = "ARRAY<STRUCT<kind: STRING, repo: STRING, role: STRING, hint: STRING, session_id: STRING>>"
VERIFICATIONS = ("ARRAY<STRUCT<outcome: STRING, evidence: STRING, at: TIMESTAMP, session_id: STRING, cwd: STRING, "
                 "self_reported: BOOLEAN>>")

CARD_BODY = (f"kind STRING, status STRING, sensitivity STRING, name STRING, gist STRING, `when` STRING, "
             f"summary STRING, steps ARRAY<STRING>, subject STRING, location STRING, reuse STRING, "
             f"applies_to STRING, invariants ARRAY<STRING>, api {API}, example {EXAMPLE}, pitfalls ARRAY<STRING>, "
             f"verify ARRAY<STRING>, stack {STACK}, domain STRING, tags ARRAY<STRING>, evidence {EVIDENCE}")

CARDS = (f"id STRING, ts TIMESTAMP, updated_at TIMESTAMP, scope STRING, partition STRING, {CARD_BODY}, "
         f"conflicts_with ARRAY<STRING>, deidentified BOOLEAN, hits LONG, applied LONG, successes LONG, "
         f"failures LONG, retrieve_count LONG, referenced LONG, reference_epoch INT, archived_at TIMESTAMP, "
         f"last_verified_at TIMESTAMP, verifications {VERIFICATIONS}, provenance STRING")

CARD_DRAFTS = f"scope STRING, partition STRING, session_id STRING, seq LONG, ts TIMESTAMP, {CARD_BODY}, provenance STRING"

FINGERPRINT = ("STRUCT<kind: STRING, key: STRING, tool: STRING, error_name: STRING, error_code: STRING, "
               "template: STRING, tokens: ARRAY<STRING>>")
GUARD = "STRUCT<tool: STRING, arg_keys: ARRAY<STRING>, pattern: STRING, all_of: ARRAY<STRING>>"

OUTCOMES = ("card_id STRING, session_id STRING, outcome STRING, evidence STRING, at TIMESTAMP, "
            "self_reported BOOLEAN")

METRICS = ("reflections LONG, skipped LONG, new_cards LONG, duplicate_cards LONG, empty_streak LONG, "
           "backoff BOOLEAN, injections LONG, gate_kept LONG, gate_dropped LONG, advisories LONG")
