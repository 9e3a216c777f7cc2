"""The classification cascade: the first rule that holds gives a site its surface, verdict, reason and confidence.

Sites have value and, where known, the facts of their container (see ``FACTS``); facts that a source doesn't give count
as absent. Detection columns (letters, bucket, detected, confidence) are taken from ``functions.lang``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lang, shapes
from ..functions.vocab import first_match

# Facts about a container, with their types.
FACTS = {
    "tier": "string", "kind": "string", "raw": "string", "extractor": "string", "path": "string", "attr": "string", "callee": "string", "tag": "string", "symbol": "string", "file_locale": "string",
    "untranslatable": "boolean", "grammar_hole": "boolean", "module_specifier": "boolean", "is_key": "boolean", "compared": "boolean", "persisted": "boolean", "enum_member": "boolean", "in_test": "boolean", "docstring": "boolean",
    "rule": "string", "rule_surface": "string", "rule_verdict": "string", "rule_reason": "string", "rule_hard": "boolean", "dual_use": "boolean",
}

# Names that tell style, wire formats, accessibility vocabulary and test matchers.
STYLE_ATTRS = r"^(className|class|style|part|slot|data-[\w-]+|key|ref|id|htmlFor|for|name|type|role)$"
STYLE_CALLEES = "^(clsx|cn|classNames|cva|tw|twMerge|styled)$"
STYLE_TAGS = r"^(css|keyframes|createGlobalStyle|injectGlobal|styled\b[\w.()'\"`-]*|tw)$"
CONTRACT_TAGS = r"^(gql|graphql|sql|Prisma\.sql|bigquery|cypher)$"
ARIA_VOCABULARY = "^aria-(live|current|pressed|sort|haspopup|autocomplete|relevant|orientation|expanded|hidden|checked|modal|busy|atomic|disabled|selected|multiline|readonly|required|invalid)$"
TEXT_ATTRS = "^(aria-(label|description|roledescription|valuetext|placeholder|details)|alt|title|placeholder|label|summary|abbr|download|content|srcdoc)$"
TEST_MATCHERS = r"(^|\.)(toBe|toEqual|toContain|toMatch|toHaveTextContent|toHaveAttribute|toMatchObject|getByRole|getByText|getByLabelText|getByTitle|getByPlaceholderText|findByRole|findByText|queryByText|getByTestId)$"
CALENDAR = "(?i)(WEEKDAY|WEEKDAYS|DAY|DAYS|MONTH|MONTHS|QUARTER|INITIAL|ABBR|SHORT)"
RENDERS = "(?i)^(format|label|render|display|describe|title|text|message)"


def _out(surface: str | Column, verdict: str, reason: str | Column | None, confidence: str, hard: bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(surface).alias("surface"), F.lit(verdict).alias("verdict"), lit(reason).alias("reason"), F.lit(confidence).alias("confidence"), F.lit(hard).alias("hard"))


def surface_of(kind: Column, docstring: Column, raw: Column) -> Column:
    return first_match(
        [
            (kind == "jsx-text", F.lit("ui.jsx-text")),
            (kind == "attr", F.lit("ui.attribute-text")),
            (kind == "template", F.lit("ui.template-literal")),
            ((kind == "comment") & docstring, F.lit("comment.docstring")),
            ((kind == "comment") & raw.startswith("/*"), F.lit("comment.block")),
            (kind == "comment", F.lit("comment.line")),
            (kind.isin("block-scalar", "prose-run"), F.lit("doc.markdown-prose")),
            (kind == "key", F.lit("identifier.object-key")),
        ],
        F.lit("ui.string-literal"),
    )


def cascade(sites: DataFrame, source: str, target: str) -> DataFrame:
    """``sites`` with surface, verdict, reason, confidence_level and hard."""
    present = {*sites.columns}
    fact = {n: F.coalesce(F.col(n).cast(t), F.lit(False)) if t == "boolean" and n in present else F.lit(False) if t == "boolean" else F.coalesce(F.col(n).cast(t), F.lit("")) if n in present else F.lit("") for n, t in FACTS.items()}
    v, key = F.col("value"), F.element_at(F.split(fact["path"], "/"), -1)
    dnt = lambda s, r, c="high", hard=False: _out(s, "do-not-translate", r, c, hard)
    judge = lambda s, r, c="high": _out(s, "needs-judgment", r, c)
    surface = surface_of(fact["kind"], fact["docstring"], fact["raw"])
    rendered = (fact["kind"] == "jsx-text") | fact["attr"].rlike(TEXT_ATTRS) | fact["symbol"].rlike(RENDERS)
    ruled = (fact["rule"] != "") & ~fact["rule_hard"]
    other_bundle = ruled & (fact["file_locale"] != "") & (fact["file_locale"] != target) & (fact["rule_verdict"] == "translate")
    tag_language = F.regexp_extract(v, shapes.LOCALE, 1)
    calendar = (F.length(v) <= 3) & fact["path"].rlike(r"/\[\d+\]$") & fact["symbol"].rlike(CALENDAR)
    cases = [
        (fact["tier"] == "sweep", _out("residual.unclassified", "unclassified", "residual", "low")),
        (fact["untranslatable"], dnt("token.api-contract", "explicitly-marked", hard=True)),
        ((fact["rule"] != "") & fact["rule_hard"], dnt(fact["rule_surface"], fact["rule_reason"], hard=True)),
        (fact["grammar_hole"], judge("ui.template-literal", "grammar-hole")),
        (fact["module_specifier"], dnt("identifier.binding", "module-specifier")),
        (fact["is_key"], dnt("identifier.object-key", "identifier")),
        (fact["compared"], dnt("token.api-contract", "api-contract")),
        (fact["persisted"], dnt("token.storage-key", "persisted-value")),
        (fact["enum_member"], dnt("token.enum-member", "enum-member")),
        (fact["dual_use"] & rendered & v.rlike(shapes.WORDY), judge("ui.string-literal", "dual-use")),
        (other_bundle, dnt(fact["rule_surface"], F.when(fact["file_locale"] == source, "source-locale-bundle").otherwise("other-locale-bundle"))),
        (ruled, F.struct(fact["rule_surface"].alias("surface"), fact["rule_verdict"].alias("verdict"), F.nullif(fact["rule_reason"], F.lit("")).alias("reason"), F.lit("high").alias("confidence"), F.lit(False).alias("hard"))),
        (fact["attr"].rlike(STYLE_ATTRS), dnt("token.style", "style-token")),
        (fact["callee"].rlike(STYLE_CALLEES), dnt("token.style", "style-token", "medium")),
        (fact["tag"].rlike(STYLE_TAGS), dnt("token.style", "style-token")),
        (fact["tag"].rlike(CONTRACT_TAGS), dnt("token.api-contract", "api-contract")),
        (shapes.is_design_token(v), dnt("token.style", "style-token")),
        (fact["attr"].rlike(ARIA_VOCABULARY), dnt("token.api-contract", "aria-vocabulary")),
        (v.rlike(shapes.MEDIA), dnt("token.api-contract", "interop-format")),
        (v.rlike(shapes.URL) | v.rlike(shapes.SLUG), dnt("token.url-slug", "url-or-slug", "medium")),
        (fact["in_test"] & fact["callee"].rlike(TEST_MATCHERS), dnt("test.fixture", "test-fixture", "medium")),
        ((fact["tier"] == "structural") & fact["extractor"].isin("yaml", "json") & ~fact["kind"].isin("comment", "block-scalar") & ~v.rlike(r"\s"), dnt("token.api-contract", "code-token", "medium")),
        (~v.rlike(shapes.WORDY) & key.rlike(shapes.LABEL_KEY), judge("ui.string-literal", "label-without-prose")),
        (~v.rlike(shapes.WORDY), dnt("token.url-slug", "numeric-or-symbolic")),
        (calendar | shapes.is_date_pattern(v), judge("ui.string-literal", "symbol-set")),
        (tag_language == source, _out("locale.declaration", "locale-marker", None, "high")),
        (tag_language != "", dnt("locale.declaration", "code-token", "medium")),
        ((F.col("detected") == target) & (F.col("confidence") >= 0.7), dnt(surface, "already-target-language", "medium")),
        (F.col("detected").isNull() & ~lang.is_cognate(v), _out(surface, "needs-judgment", F.when(F.col("bucket") == "short", "short-string").otherwise("ambiguous-role"), "low")),
        (F.col("detected") == source, _out(surface, "translate", None, "high")),
    ]
    out = sites.withColumn("_d", first_match(cases, _out(surface, "needs-judgment", "no-rule", "low")))
    d = F.col("_d")
    return out.select(*sites.columns, d["surface"].alias("surface"), d["verdict"].alias("verdict"), d["reason"].alias("reason"), d["confidence"].alias("confidence_level"), d["hard"].alias("hard"))


def classify(sites: DataFrame, source: str, target: str) -> DataFrame:
    """Detects among the pair in play (and English), then decides."""
    candidates = tuple(dict.fromkeys((source, target, "en")))
    return cascade(lang.detect_columns(sites, "value", candidates), source, target)


def harmonise(sites: DataFrame) -> DataFrame:
    """Arms of one branch move together: where one is to be translated, those refused by detection alone are too."""
    translated = F.max((F.col("verdict") == "translate").cast("int")).over(Window.partitionBy("file", "branch_group"))
    arms = sites.filter("branch_group is not null and file is not null").withColumn("any_translate", translated)
    # what belongs to no branch, most texts, stays where it is
    met = sites.filter("branch_group is null or file is null").withColumn("any_translate", F.lit(None).cast("int")).unionByName(arms)
    follows = (F.col("any_translate") == 1) & F.col("reason").isin("short-string", "ambiguous-role", "no-rule")
    return met.withColumns({"harmonised": F.coalesce(follows, F.lit(False)), "verdict": F.when(follows, "translate").otherwise(F.col("verdict"))}).drop("any_translate")
