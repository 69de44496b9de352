"""Text rules as Column expressions.  Patterns use Unicode word classes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

LETTERS = r"[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)?"


def _any(words: Iterable[str]) -> str:
    return "|".join(words)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Outer space cut, inner runs of it one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words, with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+(?:'\w+)?\b"), F.lit(0))


def normalize(c: Column) -> Column:
    """Lower case, punctuation as space, collapsed; a null text is empty."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "))


def likely_incomplete(c: Column) -> Column:
    """Whether a text is syntactically open (English, Spanish, Portuguese); an empty or null one is."""
    clean = collapse(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(F.lower(clean), F.lit(LETTERS), F.lit(0))
    last = F.element_at(words, -1)
    open_end = F.lit(False)
    for p in rules.OPEN_ENDS:
        open_end = open_end | clean.rlike(f"(?iU){p}")
    finite = clean.rlike(rf"(?iU)\b(?:{_any(rules.FINITE_VERBS)})\b")
    return (
        F.when(clean == "", True)
        .when(clean.rlike(r"(?:\.\.\.|[…—,:;-])$"), True)
        .when(clean.rlike(r"[.?!]$"), False)
        .when(open_end, True)
        .when(F.size(words) == 0, True)
        .when(last.isin(rules.CONNECTORS + rules.AUXILIARIES), True)
        .otherwise((F.size(words) >= 2) & ~finite)
    )


def completion_score(text: Column, pause_ms: Column, speaker_changed: Column, seconds: Column) -> Column:
    """How likely an utterance is over, 0 to 1, to four places: from the pause, the punctuation, the syntax, the speaker and the duration."""
    p = pause_ms.cast("double")
    a, b, c = rules.SHORT_PAUSE, rules.SENTENCE_PAUSE, rules.TURN_PAUSE
    pause = F.when(p < a, 0.0).when(p < b, 0.25 + 0.35 * (p - a) / (b - a)).when(p < c, 0.80 + 0.20 * (p - b) / (c - b)).otherwise(1.0)
    clean = collapse(F.coalesce(text, F.lit("")))
    punct = F.when(clean.rlike(r"(?:[,:;…]|\.\.\.)$"), 0.0).when(clean.rlike(r"[.?!]$"), 1.0).otherwise(0.25)
    syntax = F.when(likely_incomplete(text), 0.0).otherwise(0.85)
    w = rules.WEIGHTS
    total = w["pause"] * pause + w["punct"] * punct + w["syntax"] * syntax + w["speaker"] * speaker_changed.cast("double") + w["duration"] * F.least(F.lit(1.0), seconds / rules.LONGEST_TURN)
    return F.round(total, 4)


def drop_repetitions(c: Column) -> Column:
    """A word or phrase (to seven words) said again at once is kept once."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iU)\b(\w+)(?:\s+\1\b)+", "$1")
    for _ in range(3):
        out = F.regexp_replace(out, r"(?iU)(\b(?:\w+\s+){1,6}\w+)\s+\1\b", "$1")
    return strip(out)


def spoken(c: Column) -> Column:
    """English speech without leading fillers and hedges; a capital at the start stays one."""
    clean = strip(c)
    for p in rules.LEADING_FILLERS:
        clean = F.regexp_replace(clean, f"(?i){p}", "")
    for p, to in rules.HEDGES:
        clean = F.regexp_replace(clean, f"(?iU){p}", to)
    clean = strip(F.regexp_replace(clean, r"\s{2,}", " "))
    first = clean.substr(1, 1)
    capital = (first != F.upper(first)) & (c.substr(1, 1) != F.lower(c.substr(1, 1)))
    return F.when(capital, F.concat(F.upper(first), clean.substr(F.lit(2), F.length(clean)))).otherwise(clean)


def with_repairs(df: DataFrame, column: str, out: str = "repaired", least: float = 0.85) -> DataFrame:
    """``df`` with ``out`` (text, confidence, changed): recognized English text after repairs.

    Stutters, contractions, misheard phrases and stray punctuation are mended,
    if the mean confidence of the rules that apply is at least ``least``.  Each
    rule's text is a column of its own, as the next rule and the confidence
    both need it and an expression would work it out again for each.
    """
    triple = r"(?iU)\b(\w+)(?:\s+\1\b){2,}"
    double = rf"(?iU)\b({_any(rules.FUNCTION_WORDS)})\s+\1\b"
    steps = [(rf"(?iU)\b{word}\b", to, 0.90) for word, to in rules.CONTRACTIONS] + [(f"(?iU){p}", to, weight) for p, to, weight in rules.ACOUSTIC_REPAIRS]
    now = df.withColumn("_t", strip(F.coalesce(F.col(column), F.lit(""))))
    now = now.withColumn("_had", F.col("_t").rlike(triple)).withColumn("_w", F.when(F.col("_had") | F.col("_t").rlike(double), F.lit(0.95)))
    now = now.withColumn("_t0", F.when(F.col("_had"), F.regexp_replace("_t", triple, "$1")).otherwise(F.regexp_replace("_t", double, "$1")))
    for k, (pattern, to, weight) in enumerate(steps):
        now = now.withColumn(f"_w{k}", F.when(F.col(f"_t{k}").rlike(pattern), F.lit(weight))).withColumn(f"_t{k + 1}", F.regexp_replace(f"_t{k}", pattern, to))
    last, ends = f"_t{len(steps)}", (r"^[\s,;:\-]+", r"[\s,;:\-]+$")
    now = now.withColumn("_end", strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, ends[0], ""), ends[1], ""), r"\s{2,}", " ")))
    weights = F.array_compact(F.array("_w", *[f"_w{k}" for k in range(len(steps))], F.when(F.col("_end") != F.col(last), F.lit(0.95))))
    now = now.withColumn("_all", weights).withColumn("_mean", F.when(F.size("_all") == 0, 1.0).otherwise(F.aggregate("_all", F.lit(0.0), lambda a, x: a + x) / F.size("_all")))
    good = F.col("_mean") >= least
    result = F.struct(F.when(good, F.col("_end")).otherwise(F.col("_t")).alias("text"), F.round("_mean", 2).alias("confidence"), (good & (F.col("_end") != F.col("_t"))).alias("changed"))
    return now.select(*[c for c in df.columns if c != out], result.alias(out))


def keep_case(found: Column, replacement: Column) -> Column:
    """A replacement in the case of what was found: upper, title, lower, or as it is."""
    rest = found.substr(F.lit(2), F.length(found))
    is_upper = (found == F.upper(found)) & (found != F.lower(found))
    is_lower = (found == F.lower(found)) & (found != F.upper(found))
    title = (found.substr(1, 1) != F.lower(found.substr(1, 1))) & ((F.length(found) == 1) | ((rest == F.lower(rest)) & (rest != F.upper(rest))))
    capital = F.concat(F.upper(replacement.substr(1, 1)), F.lower(replacement.substr(F.lit(2), F.length(replacement))))
    return F.when(is_upper, F.upper(replacement)).when(title, capital).when(is_lower, F.lower(replacement)).otherwise(replacement)


def apply_glossary(c: Column, glossary: dict[str, str]) -> Column:
    """Whole terms replaced in their case, the longest first; later terms may match what earlier ones put in.

    A glossary is a small configured dictionary; keys that begin with two
    underscores are comments.
    """
    def escaped(x: str) -> str:
        return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in x)

    out = c
    terms = sorted(((k.strip(), v.strip()) for k, v in glossary.items() if not k.startswith("__")), key=lambda t: -len(t[0]))
    for term, to in terms:
        if not term:
            continue
        quoted = to.replace("\\", "\\\\").replace("$", "\\$")
        forms = {term.lower(): quoted.lower(), term[:1].upper() + term[1:].lower(): quoted[:1].upper() + quoted[1:].lower(), term.upper(): quoted.upper()}
        for case, form in forms.items():
            out = F.regexp_replace(out, rf"(?U)(?<!\w){escaped(case)}(?!\w)", form)
        if term.lower() != to.lower():
            out = F.regexp_replace(out, rf"(?iU)(?<!\w){escaped(term)}(?!\w)", quoted)
    return out


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def timestamp(seconds: Column, separator: str = ",") -> Column:
    """HH:MM:SS and milliseconds, rounded half to even, not below zero."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0"))


def model_for_language(model: Column, language: Column) -> Column:
    """An English-only model's name loses its suffix where other languages may come."""
    other = language.isNull() | F.lower(strip(language)).isin(*rules.MULTILINGUAL)
    return F.when(model.endswith(".en") & other, F.regexp_replace(model, r"\.en$", "")).otherwise(model)


def anomaly(text: Column, confidence: Column, logprob: Column, no_speech: Column) -> Column:
    """The first check that recognized text fails: empty, no_speech, logprob, confidence, unpronounceable; else ok."""
    letters = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-zA-ZáéíóúÁÉÍÓÚñÑ]", ""))
    odd = F.exists(letters, lambda w: (F.length(w) >= 6) & ~w.rlike("(?iu)[aeiouyáéíóú]"))
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", "empty")
        .when(no_speech > rules.NO_SPEECH, "no_speech")
        .when(logprob < rules.LOGPROB, "logprob")
        .when(confidence < rules.CONFIDENCE, "confidence")
        .when(odd, "unpronounceable")
        .otherwise("ok")
    )


def incomplete_english(c: Column) -> Column:
    """The simpler English rule: open phrases, trailing links or auxiliaries, or three words and more without an end; empty is complete."""
    clean = strip(F.coalesce(c, F.lit("")))
    words = tokens(clean)
    last = F.element_at(words, -1)
    opened = clean.rlike(r"(?:\.\.\.|[…—-])$")
    for p in rules.OPEN_PHRASES:
        opened = opened | clean.rlike(rf"(?iU)\b{p}")
    link = F.coalesce(last.isin(rules.CONTINUATIONS + rules.ENGLISH_AUXILIARIES), F.lit(False))
    return (clean != "") & (opened | (F.size(words) > 0) & (link | (F.size(words) >= 3) & ~clean.rlike(r"[.!?]$") & clean.rlike(r"\p{L}")))


def continues(c: Column) -> Column:
    """Whether an English fragment goes on from one before: a small first letter (but for I) or a linking word."""
    clean = strip(F.coalesce(c, F.lit("")))
    small = clean.rlike(r"^\p{Ll}") & ~clean.rlike(r"^i[ ']")
    return (clean != "") & (small | F.coalesce(F.get(tokens(clean), F.lit(0)).isin(rules.CONTINUATIONS), F.lit(False)))


def subtitle(c: Column, width: int = 42) -> Column:
    """A text on one line, or on two at the best break: near the middle, within the width, after punctuation, before a conjunction, not after an article.

    The first of equally good breaks is taken.
    """
    clean = collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iU)\b(\w{3,})\s+\1\b", "$1"))
    words = F.split(clean, " ")
    total = F.length(clean)

    def over(n: Column) -> Column:
        return F.greatest(F.lit(0), n - width) * 10.0

    def judged(acc: Column, pair: Column) -> Column:
        word, following = pair["w"], F.regexp_replace(F.lower(pair["n"]), r"[,;:.!?]+$", "")
        end = acc["end"] + F.length(word) + F.when(acc["end"] > 0, 1).otherwise(0)
        score = (
            F.abs(end - total / 2) + over(end) + over(total - end - 1)
            - F.when(word.rlike("[,;:.]$"), 15.0).otherwise(0.0) - F.when(following.isin(rules.BREAKS), 8.0).otherwise(0.0) + F.when(F.lower(word).isin(rules.ARTICLES), 25.0).otherwise(0.0)
        )
        return F.struct(end.cast("int").alias("end"), F.least(acc["best"], F.struct(score.cast("double").alias("score"), end.cast("int").alias("at"))).alias("best"))

    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    start = F.struct(F.lit(0).cast("int").alias("end"), F.struct(F.lit(float("inf")).cast("double").alias("score"), F.lit(0).cast("int").alias("at")).alias("best"))
    at = F.aggregate(pairs, start, judged, lambda a: a["best"]["at"])
    return F.when((total <= width) | (F.size(words) < 2), clean).otherwise(F.concat(F.substring(clean, F.lit(1), at), F.lit("\n"), F.substring(clean, at + 2, total)))


def brief_answer(c: Column, other_spoke: Column) -> Column:
    """The Spanish for an English answer of a word or two, if another speaker's turn is in the context; else null."""
    key = F.regexp_replace(F.lower(strip(c)), r"\.$", "")
    known = F.create_map(*[F.lit(x) for pair in rules.BRIEF_ANSWERS.items() for x in pair])
    return F.when(other_spoke, F.element_at(known, key))


def natural_spanish(translated: Column, original: Column) -> Column:
    """A Spanish translation of English with what came out word for word put as it is said.

    Some rules look at the English text as well; a null one lets only the
    others apply.
    """
    out, source = translated, F.coalesce(strip(original), F.lit(""))
    for p, to in rules.NATURAL_SPANISH:
        out = F.regexp_replace(out, f"(?iU){p}", to)
    shines = source.rlike(r"(?iU)\bshines?\s+through\b") & ~out.contains("nota") & ~out.contains("destaca")
    out = F.when(shines, F.regexp_replace(out, r"(?iU)\bbrilla\b", "se nota")).otherwise(out)
    diary = F.lower(source).contains("journaling") & ~out.rlike(r"(?iU)escribir\s+en\s+un\s+diario")
    out = F.when(diary, F.regexp_replace(out, r"(?iU)(?:haciendo|tomando|llevando)?\s*un\s+diario", "escribir en un diario")).otherwise(out)
    return F.when(source.rlike(r"(?U)^[a-zA-Z]+ing\b"), F.regexp_replace(F.regexp_replace(out, "^Caminando ", "Salir a caminar "), "^caminando ", "salir a caminar ")).otherwise(out)


def without_artifacts(translated: Column, original: Column) -> Column:
    """A translation without the dashes of a dialogue and the question that a model puts before it; a dash of the original stays."""
    out = strip(F.regexp_replace(translated, r"(?iU)^[-—–]\s*¿Qué\?\s*[-—–]?\s*", ""))
    added = ~F.coalesce(original, F.lit("")).rlike("^[-—–]") & out.rlike("^[-—–]")
    return F.when(added, strip(F.regexp_replace(out, r"^[-—–]\s*", ""))).otherwise(out)


def clean_source(c: Column, glossary: dict[str, str]) -> Column:
    """English text for translation: collapsed, and whole terms of the glossary replaced in any case, where the replacement is ASCII."""
    out = collapse(F.coalesce(c, F.lit("")))
    for term, to in glossary.items():
        if term and to.isascii() and not term.startswith("__"):
            literal = "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in term)
            out = F.regexp_replace(out, rf"(?iU)\b{literal}\b", to.replace("\\", "\\\\").replace("$", "\\$"))
    return out
