"""Table schemas as DDL strings."""

FINDING = "tool string, severity string, rule_id string, file_path string, line int, message string, snippet string, stage string"

SCAN_ROW = (
    "repo string, status string, verified boolean, stages_present int, dockerfiles_found int, entry_points_resolved int, entry_files string, "
    "entry_route string, reachable_files int, total_functions int, max_depth int, parse_errors int, dynamic_imports int, detail string"
)

SNAPSHOT = (
    "repo string, entry_route string, entry_files array<string>, stages_present int, analysis string, reachable_files array<string>, "
    "rq2_context_files_note string, rq2_context_files map<string, array<string>>, stages_with_files map<string, array<string>>"
)

CHECKS = "checks array<struct<category: string, present: boolean, evidence_line: string, evidence_snippet: string, justification: string>>"

ISSUE = (
    "repo string, issue_number int, title string, labels array<string>, created_at timestamp, closed_at timestamp, comments int, "
    "pipeline_relevance boolean, matched_keywords array<string>, body_excerpt string"
)

FACT = "repo string, tool string, rule_id string, semantic_category string, severity string, severity_source string, file_path string, line int, stage_raw string, stages string, n_stages int, scope string"

FILE = "repo string, path string, content string"
