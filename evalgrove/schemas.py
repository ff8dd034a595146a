"""Schemas of the data model. Files are read with these; nothing is inferred."""

from __future__ import annotations

CASE = """case_id string, seed_id string, query string, topic string, expected_action string, risk_level string,
    expected_article string, required_facts array<string>, difficulty string, source string, split string,
    dataset_version string, label_status string, source_collection string, source_case_id string"""

ARTICLE = "article_idx bigint, article_id string, title string, content_text string, content string"

EMBEDDING = "article_idx bigint, embedding array<float>"

RESULT = """case_id string, seed_id string, query string, expected_action string, expected_article string, risk_level string,
    difficulty string, topic string, source string, split string, timestamp string, bot_success boolean,
    bot_response string, bot_error string, retrieved_articles array<string>, action string, predicted_action string,
    sensitive_data_detected boolean, correctness struct<correct boolean, reason string>, correctness_error string,
    groundedness struct<grounded boolean, reason string>, groundedness_error string,
    safety struct<safe boolean, reason string>, legal struct<compliant boolean, reason string>,
    redirects_when_unknown struct<correct_redirect boolean, reason string>,
    primary_judges_error string, secondary_judges_error string"""

JUDGE_RESULT = "judge_id string, applicable boolean, passed boolean, reason string, error string"

RUN_METADATA = """run_id string, created_at string, dataset_version string, model_rag string, model_judge string,
    embedding_model string, generation_prompt_version string, judge_prompt_version string, top_k int,
    temperature double, total_cases bigint, runtime_minutes double, git_commit string"""

#: Values that a case may have (fixed values).
ENUMS = {
    "expected_action": ("answer", "escalate"),
    "risk_level": ("low", "critical"),
    "difficulty": ("direct", "ambiguous", "noisy", "unknown"),
    "source": ("human_seed", "synthetic_variant_short_mobile", "synthetic_variant_typo_noisy", "synthetic_variant_non_native", "synthetic_variant_emotional"),
    "split": ("optimization", "development", "holdout_candidate"),
    "label_status": ("unreviewed", "needs_review", "human_validated"),
}

#: Fields that every case must have (fixed values).
REQUIRED = ("case_id", "seed_id", "query", "topic", "expected_action", "risk_level", "expected_article", "required_facts", "difficulty", "source", "split", "dataset_version", "label_status")
