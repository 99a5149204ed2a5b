"""The rules: what they are, whether they run by default and what evidence says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, a row for each rule: id, category, severity, AI-specific, off in the source, current policy (on, off, qc: candidate and off,
#: ret: retired, sup: superseded), verdict of the past.
RULES = (
    ("ai/any-density", "ai", "medium", True, False, "qc", "USEFUL"),
    ("ai/comment-ratio", "ai", "medium", True, False, "off", "USEFUL"),
    ("ai/compression-profile", "ai", "low", True, False, "off", "USEFUL"),
    ("ai/console-debug-storm", "ai", "low", True, False, "qc", "USEFUL"),
    ("ai/default-react-stack", "ai", "low", True, True, "off", "USEFUL"),
    ("ai/errors-near-eof", "ai", "medium", True, False, "off", "USEFUL"),
    ("ai/fetch-default-overuse", "ai", "low", True, False, "qc", "USEFUL"),
    ("ai/library-reinvention", "ai", "medium", True, True, "off", "USEFUL"),
    ("ai/markdown-leakage", "ai", "high", True, True, "off", "OK"),
    ("ai/renyi-profile", "ai", "medium", True, False, "ret", "OK"),
    ("ai/segment-surprisal-cv", "ai", "medium", True, True, "off", "USEFUL"),
    ("ai/state-default-overuse", "ai", "low", True, False, "qc", "USEFUL"),
    ("ai/tailwind-color-overuse", "ai", "low", True, False, "qc", "USEFUL"),
    ("ai/text-like-ratio", "ai", "low", True, True, "off", "USEFUL"),
    ("ai/whitespace-regularity", "ai", "medium", True, False, "off", "USEFUL"),
    ("component/giant-component", "component", "high", True, False, "qc", "USEFUL"),
    ("component/multiple-components-per-file", "component", "medium", False, False, "qc", "USEFUL"),
    ("component/shadcn-prop-mismatch", "component", "high", True, False, "ret", "USEFUL"),
    ("context/import-path-mismatch", "arch", "medium", False, False, "on", "USEFUL"),
    ("cpp/c-style-cast", "typo", "low", True, False, "on", "HYGIENE"),
    ("cpp/magic-numbers", "typo", "low", True, False, "qc", "HYGIENE"),
    ("cpp/printf-debug", "typo", "low", True, False, "qc", "OK"),
    ("cpp/raw-new-delete", "typo", "low", True, False, "on", "HYGIENE"),
    ("cs/async-without-await", "logic", "medium", False, False, "on", "DORMANT"),
    ("cs/empty-catch-block", "logic", "medium", False, False, "on", "DORMANT"),
    ("cs/sql-string-interpolation", "security", "high", False, False, "on", "DORMANT"),
    ("dart/dynamic-call", "logic", "medium", True, True, "off", "DORMANT"),
    ("dart/missing-dispose", "logic", "high", True, True, "off", "DORMANT"),
    ("dart/print-debug", "logic", "medium", True, True, "off", "DORMANT"),
    ("dart/unwrapped-futures", "logic", "high", True, True, "off", "DORMANT"),
    ("db/sql-concat", "db", "high", True, False, "sup", "USEFUL"),
    ("dead/dead-branch", "logic", "medium", True, False, "qc", "OK"),
    ("dead/unreachable", "logic", "high", True, False, "on", "HYGIENE"),
    ("dead/unused-import", "logic", "low", True, False, "on", "USEFUL"),
    ("dead/unused-local", "logic", "low", True, False, "on", "HYGIENE"),
    ("dead/unused-parameter", "logic", "low", True, False, "on", "HYGIENE"),
    ("docs/broken-link", "docs", "low", False, False, "on", "OK"),
    ("docs/stale-function-reference", "docs", "medium", False, False, "on", "USEFUL"),
    ("docs/stale-package-reference", "docs", "medium", False, False, "on", "OK"),
    ("dup/identical-block", "logic", "medium", False, True, "on", "DORMANT"),
    ("dup/near-duplicate", "logic", "medium", True, False, "off", "DORMANT"),
    ("dup/structural-clone", "logic", "medium", True, True, "off", "DORMANT"),
    ("go/nil-slice-vs-empty", "typo", "low", True, False, "off", "DORMANT"),
    ("go/struct-tag-inconsistency", "typo", "low", True, False, "off", "DORMANT"),
    ("java/lost-stack-trace", "logic", "medium", False, False, "on", "OK"),
    ("java/sql-string-concat", "security", "high", False, False, "on", "DORMANT"),
    ("java/suspicious-implementation", "security", "high", False, False, "qc", "OK"),
    ("java/thread-sleep-in-loop", "perf", "medium", False, False, "on", "DORMANT"),
    ("kt/coroutine-cancellation-missing", "logic", "medium", False, False, "on", "DORMANT"),
    ("kt/force-unwrap", "logic", "medium", False, False, "on", "DORMANT"),
    ("kt/global-coroutine-scope", "logic", "medium", False, False, "on", "DORMANT"),
    ("kt/string-template-injection", "security", "high", False, False, "on", "DORMANT"),
    ("layout/gap-monopoly", "layout", "medium", False, True, "qc", "USEFUL"),
    ("layout/math-element-uniformity", "layout", "medium", True, False, "ret", "USEFUL"),
    ("layout/math-grid-uniformity", "layout", "high", True, True, "off", "USEFUL"),
    ("layout/spacing-grid", "layout", "medium", False, True, "qc", "USEFUL"),
    ("logic/boundary-violation", "logic", "high", False, False, "qc", "USEFUL"),
    ("logic/ghost-defensive", "logic", "medium", True, False, "off", "USEFUL"),
    ("logic/heaps-deviation", "logic", "medium", False, False, "qc", "OK"),
    ("logic/key-prop-missing", "logic", "high", False, False, "on", "USEFUL"),
    ("logic/math-any-density", "logic", "high", True, False, "sup", "USEFUL"),
    ("logic/math-console-log-storm", "logic", "high", True, False, "sup", "USEFUL"),
    ("logic/math-gini-class-usage", "logic", "high", True, False, "ret", "USEFUL"),
    ("logic/math-variable-name-entropy", "logic", "high", False, False, "qc", "HYGIENE"),
    ("logic/optimistic-no-rollback", "logic", "high", True, False, "off", "USEFUL"),
    ("logic/reactive-hook-soup", "logic", "medium", True, False, "qc", "USEFUL"),
    ("logic/zipf-slope-anomaly", "logic", "medium", False, False, "qc", "USEFUL"),
    ("logic/zombie-state", "logic", "medium", True, False, "qc", "USEFUL"),
    ("perf/cls-image", "perf", "low", False, False, "on", "USEFUL"),
    ("perf/css-bloat", "perf", "low", False, False, "qc", "USEFUL"),
    ("php/empty-catch", "logic", "medium", False, False, "on", "DORMANT"),
    ("php/sql-injection", "security", "high", False, False, "on", "DORMANT"),
    ("product/terminology-drift", "arch", "medium", False, False, "qc", "USEFUL"),
    ("product/ux-pattern-fragmentation", "arch", "medium", True, False, "off", "USEFUL"),
    ("rb/exception-swallowing", "logic", "medium", False, False, "on", "DORMANT"),
    ("rb/n-plus-one-query", "perf", "medium", False, False, "qc", "DORMANT"),
    ("rb/sql-string-concat", "security", "high", False, False, "on", "DORMANT"),
    ("rust/stringly-typed", "logic", "medium", True, False, "qc", "USEFUL"),
    ("rust/todo-macro", "logic", "medium", True, False, "on", "OK"),
    ("rust/unused-pub-fn", "logic", "low", True, False, "ret", "OK"),
    ("rust/unwrap-in-production", "logic", "medium", True, False, "qc", "USEFUL"),
    ("security/dangerous-cors", "security", "medium", True, False, "qc", "USEFUL"),
    ("security/eval", "security", "high", False, False, "on", "OK"),
    ("security/exposed-env-var", "security", "high", False, False, "on", "USEFUL"),
    ("security/fail-open-auth", "security", "high", True, False, "qc", "USEFUL"),
    ("security/hardcoded-secret", "security", "high", True, False, "on", "USEFUL"),
    ("security/localstorage-token", "security", "high", False, False, "on", "USEFUL"),
    ("security/missing-auth-check", "security", "medium", False, False, "on", "USEFUL"),
    ("security/public-admin-route", "security", "medium", False, False, "on", "USEFUL"),
    ("security/sql-construction", "security", "high", True, False, "on", "USEFUL"),
    ("security/target-blank-no-noopener", "security", "medium", False, False, "on", "USEFUL"),
    ("security/unsafe-html-render", "security", "high", False, False, "on", "USEFUL"),
    ("swift/fatal-error-thrown", "logic", "high", True, False, "off", "DORMANT"),
    ("swift/force-unwrap", "logic", "medium", True, False, "off", "DORMANT"),
    ("swift/implicitly-unwrapped-optional", "typo", "low", True, False, "off", "DORMANT"),
    ("swift/print-debug", "typo", "low", True, False, "off", "OK"),
    ("swift/strong-self-capture", "logic", "medium", True, False, "off", "DORMANT"),
    ("test/duplicate-setup", "test", "medium", True, False, "qc", "USEFUL"),
    ("test/fake-placeholder", "test", "high", True, False, "ret", "USEFUL"),
    ("test/weak-assertion", "test", "medium", True, False, "off", "USEFUL"),
    ("ts/enum-vs-as-const", "typo", "low", True, False, "off", "DORMANT"),
    ("ts/excessive-type-assertion", "typo", "low", True, False, "off", "DORMANT"),
    ("ts/import-type-misuse", "typo", "low", True, False, "off", "DORMANT"),
    ("ts/never-vs-unknown", "typo", "low", True, False, "off", "DORMANT"),
    ("typo/math-button-label-uniformity", "typo", "medium", False, False, "qc", "USEFUL"),
    ("typo/placeholder-text", "typo", "low", False, False, "on", "USEFUL"),
    ("visual/arbitrary-escape", "visual", "medium", True, False, "qc", "USEFUL"),
    ("visual/inline-style-dominance", "visual", "medium", False, False, "qc", "USEFUL"),
    ("visual/math-color-cluster", "visual", "high", True, True, "off", "USEFUL"),
    ("visual/math-default-font", "visual", "high", True, True, "off", "USEFUL"),
    ("visual/math-font-entropy", "visual", "high", True, True, "off", "USEFUL"),
    ("visual/math-rounded-entropy", "visual", "high", True, True, "off", "USEFUL"),
    ("visual/math-spacing-entropy", "visual", "medium", True, True, "off", "USEFUL"),
    ("visual/naturalness-anomaly", "visual", "medium", True, False, "ret", "USEFUL"),
    ("visual/radius-scale-violation", "visual", "medium", False, True, "qc", "USEFUL"),
    ("visual/spacing-scale-violation", "visual", "medium", False, False, "qc", "USEFUL"),
    ("wcag/focus-appearance", "wcag", "high", False, False, "on", "USEFUL"),
    ("wcag/focus-obscured", "wcag", "low", False, False, "on", "USEFUL"),
    ("wcag/missing-alt", "wcag", "medium", False, True, "on", "USEFUL"),
)
COLUMNS = "rule_id string, category string, severity string, ai_specific boolean, default_off boolean, policy string, verdict string"


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), COLUMNS)


def catalog_sql() -> str:
    """The same table as SQL."""
    return "SELECT * FROM (VALUES " + ", ".join(str(r).replace("True", "true").replace("False", "false") for r in RULES) + ") AS t(rule_id, category, severity, ai_specific, default_off, policy, verdict)"
