"""Language detection as column expressions, and the same computation as DuckDB SQL for the oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .lang_data import COGNATES, LANGUAGES, NOT_PROSE, ORTHOGRAPHY, PATH_WORDS, SCRIPTS, STOPWORDS

TOKEN_BREAK = r"[^\p{L}'’]+"


#: Java's spelling of patterns whose word boundaries stand beside a word's own character, so that one look suffices; and
#: possessive, as what follows a run is no part of it.
QUICK = {
    r"https?://\S+|\b[\w.-]+/[\w./-]+": r"https?://\S++|(?:(?<!\w)\w|(?<=\w)[.-])[\w.-]*+/[\w./-]++",
    r"\b[a-z]+[A-Z]\w*": r"(?<!\w)[a-z]++[A-Z]\w*+",
    r"\b[A-Z][A-Z0-9_]{2,}\b": r"[A-Z](?<!\w[A-Z])[A-Z0-9_]{2,}+(?!\w)",
    r"\b\w+[_-]\w+\b": r"(?<!\w)\w+[_-]\w++",
    r"\b\w+(?:\.\w+)+\b": r"(?<!\w)\w++(?:\.\w++)++",
}

#: What every match of a pattern holds; a text without it isn't searched.
MARKS = {r"\{\d+\}": "{", r"\{\{[^}]*\}\}": "{{", r"%[sd@]|%\d+\$[sd@]": "%", r"https?://\S+|\b[\w.-]+/[\w./-]+": "/", r"`[^`]*`": "`", r"<[^>]+>": "<"}


def normalized(text: Column) -> Column:
    """What a person reads: placeholders, addresses, code and numbers become spaces."""

    def blanked(c: Column, p: str) -> Column:
        replaced = lambda x: F.regexp_replace(x, QUICK[p], " ") if p in QUICK else rx.replace_all(x, p, " ")
        if p not in MARKS:
            return replaced(c)
        # the element of a list, so that the text so far is made once
        return F.get(F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit(MARKS[p])), replaced(x)).otherwise(x)), F.lit(0))

    out = reduce(blanked, NOT_PROSE, text)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def bucket(letters: Column) -> Column:
    return F.when(letters == 0, "none").when(letters < 8, "short").when(letters < 20, "medium").when(letters < 60, "long").otherwise("very-long")


def is_cognate(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(COGNATES)


def path_word_language(word: Column) -> Column:
    """The language of a word of file names, null if none claims it."""
    owner = {w: lang for lang, words in PATH_WORDS.items() for w in words.split()}
    cases = [(lang, [w for w, x in owner.items() if x == lang]) for lang in PATH_WORDS]
    return reduce(lambda c, x: c.when(F.lower(word).isin(x[1]), x[0]), cases[1:], F.when(F.lower(word).isin(cases[0][1]), cases[0][0]))


def _is_stopword(lang: str):
    words = STOPWORDS[lang].split()
    return lambda t: t.isin(words)


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def detect_columns(df, text: str, candidates=LANGUAGES, prefix: str = ""):
    """``df`` with letters, bucket, detected, confidence, method (each after ``prefix``).

    Detection refuses rather than guesses: no letters, a cognate, a short text, or a medium one without a clear winner.
    """
    p = prefix
    df = df.withColumn("_norm", normalized(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumns({f"{p}letters": F.length(F.regexp_replace("_norm", r"\P{L}+", "")).cast("long"), "_tokens": F.filter(F.split(F.lower("_norm"), TOKEN_BREAK), lambda t: t != "")})
    # most tokens are no stopword of any language, and are looked at once
    every = sorted({w for lang in candidates for w in STOPWORDS[lang].split()})
    df = df.withColumn("_known", F.filter("_tokens", lambda t: t.isin(every)))
    hits = {lang: F.size(F.filter("_known", _is_stopword(lang))) for lang in candidates if STOPWORDS[lang]}
    df = df.withColumns({f"_h_{lang}": h for lang, h in hits.items()})
    marks = {lang: [(pattern, w) for x, pattern, w in ORTHOGRAPHY if x == lang] for lang in candidates}
    ortho = {f"_o_{lang}": reduce(lambda a, b: a + b, (F.when(rx.matches(F.col("_norm"), pattern), w).otherwise(0.0) for pattern, w in ms)) for lang, ms in marks.items() if ms}
    df = df.withColumns(ortho)
    n = F.greatest(F.size("_tokens"), F.lit(1))
    scores = []
    for lang in candidates:
        h = F.col(f"_h_{lang}") if lang in hits else F.lit(0)
        o = F.col(f"_o_{lang}") if marks[lang] else F.lit(0.0)
        total = (h / n) * 1.6 + o
        scores.append(F.when(total > 0, F.struct((-total).alias("score"), F.lit(lang).alias("lang"))))
    df = df.withColumn("_ranked", F.array_sort(F.filter(F.array(*scores), lambda s: s.isNotNull())))
    letters, b = F.col(f"{p}letters"), bucket(F.col(f"{p}letters"))
    top, second = -F.get("_ranked", F.lit(0))["score"], F.coalesce(-F.get("_ranked", F.lit(1))["score"], F.lit(0.0))
    margin = (top - second) / top
    refused = (letters == 0) | F.lower("_norm").isin(COGNATES) | (F.size("_tokens") == 0) | (F.size("_ranked") == 0) | (b == "short") | ((b == "medium") & (margin < 0.25))
    script = reduce(lambda c, x: c.when(F.col("_norm").rlike(x[1]), x[0]), [s for s in SCRIPTS if s[0] in candidates], F.when(F.lit(False), F.lit(None).cast("string")))
    prior = F.when(b == "medium", 0.75).when(b == "long", 0.9).otherwise(1.0)
    any_hit = reduce(lambda a, x: a | x, (F.col(f"_h_{x}") > 0 for x in hits))
    any_mark = reduce(lambda a, x: a | x, (F.col(c) > 0 for c in ortho)) if ortho else F.lit(False)
    asked = (letters > 0) & ~F.lower("_norm").isin(COGNATES)
    df = df.withColumns({f"{p}bucket": b, "_script": F.when(asked, script), "_refused": refused})
    df = df.withColumns({
        f"{p}detected": F.when(F.col("_script").isNotNull(), F.col("_script")).when(~F.col("_refused"), F.get("_ranked", F.lit(0))["lang"]),
        f"{p}confidence": F.when(F.col("_script").isNotNull(), 0.97).when(~F.col("_refused"), round2(F.least(F.lit(1.0), (0.5 + margin * 0.5) * prior))).otherwise(0.0),
        f"{p}method": F.when(F.col("_script").isNotNull(), "script").when(F.col("_refused"), "none").when(any_hit & any_mark, "combined").when(any_hit, "stopword").otherwise("trigram"),
    })
    out = [f"{p}{x}" for x in ("letters", "bucket", "detected", "confidence", "method")]
    kept = [c for c in df.columns if c not in out and c not in ("_norm", "_tokens", "_known", "_ranked", "_script", "_refused") and not c.startswith(("_h_", "_o_"))]
    # as generated rows (one for one), so that a filter on a verdict isn't pushed below and spelt out again for every use
    return df.select(*kept, F.inline(F.array(F.struct(*out))))


def normalized_sql(expr: str) -> str:
    out = reduce(lambda e, p: rx.replace_all_sql(e, p, " "), NOT_PROSE, expr)
    return f"trim({rx.replace_all_sql(out, chr(92) + 's+', ' ')})"


def detect_sql(table: str, text: str, keep: str, candidates=LANGUAGES) -> str:
    """A SELECT of ``keep`` with letters, bucket, detected, confidence, method over ``table``."""
    quoted = ", ".join(rx.sql(w) for w in COGNATES)
    hits = [lang for lang in candidates if STOPWORDS[lang]]
    h = ",\n".join(f"len(list_filter(tokens, lambda t: t IN ({', '.join(rx.sql(w) for w in STOPWORDS[lang].split())}))) AS h_{lang}" for lang in hits)
    marks = {lang: [(p, w) for x, p, w in ORTHOGRAPHY if x == lang] for lang in candidates}
    o = ",\n".join(f"({' + '.join(f'CASE WHEN regexp_matches(norm, {rx.sql(p)}) THEN {w:.2f}::DOUBLE ELSE 0.0::DOUBLE END' for p, w in ms) or '0.0::DOUBLE'}) AS o_{lang}" for lang, ms in marks.items())
    total = {lang: (f"(h_{lang}::DOUBLE / greatest(len(tokens), 1)) * 1.6::DOUBLE + o_{lang}" if lang in hits else f"o_{lang}") for lang in candidates}
    ranked = ", ".join(f"CASE WHEN {e} > 0 THEN {{'score': -({e}), 'lang': '{lang}'}} END" for lang, e in total.items())
    scripts = " ".join(f"WHEN regexp_matches(norm, {rx.sql(p)}) THEN '{lang}'" for lang, _, p in SCRIPTS if lang in candidates)
    script = f"CASE WHEN letters = 0 OR lower(norm) IN ({quoted}) THEN NULL {scripts} ELSE NULL END"
    any_hit = " OR ".join(f"h_{x} > 0" for x in hits)
    any_mark = " OR ".join(f"o_{x} > 0" for x in candidates)
    return f"""
    SELECT {keep}, letters, bucket,
      CASE WHEN script IS NOT NULL THEN script WHEN NOT refused THEN ranked[1].lang END AS detected,
      CASE WHEN script IS NOT NULL THEN 0.97::DOUBLE WHEN NOT refused THEN floor(least(1.0::DOUBLE, (0.5::DOUBLE + margin * 0.5::DOUBLE) *
        CASE bucket WHEN 'medium' THEN 0.75::DOUBLE WHEN 'long' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) * 100 + 0.5::DOUBLE) / 100 ELSE 0.0::DOUBLE END AS confidence,
      CASE WHEN script IS NOT NULL THEN 'script' WHEN refused THEN 'none' WHEN ({any_hit}) AND ({any_mark}) THEN 'combined' WHEN ({any_hit}) THEN 'stopword' ELSE 'trigram' END AS method
    FROM (SELECT *, {script} AS script,
        letters = 0 OR lower(norm) IN ({quoted}) OR len(tokens) = 0 OR len(ranked) = 0 OR bucket = 'short' OR (bucket = 'medium' AND coalesce(margin, 0) < 0.25) AS refused
      FROM (SELECT *, (-ranked[1].score - coalesce(-ranked[2].score, 0)) / -ranked[1].score AS margin,
          CASE WHEN letters = 0 THEN 'none' WHEN letters < 8 THEN 'short' WHEN letters < 20 THEN 'medium' WHEN letters < 60 THEN 'long' ELSE 'very-long' END AS bucket
        FROM (SELECT *, list_sort(list_filter([{ranked}], lambda s: s IS NOT NULL)) AS ranked
          FROM (SELECT *, {h}, {o}
            FROM (SELECT *, len(regexp_extract_all(norm, '\\p{{L}}')) AS letters, list_filter(regexp_split_to_array(lower(norm), {rx.sql(TOKEN_BREAK)}), lambda t: t <> '') AS tokens
              FROM (SELECT *, {normalized_sql(f"coalesce({text}, '')")} AS norm FROM {table}))))))
    """
