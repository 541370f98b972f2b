"""Line-first quality rules [native]: judge every line, remove the failing ones, then reject documents that lose too much.

A line fails by punctuation (symbols or marks for words, capitals, a short line that doesn't end a sentence), as navigation (bars
between words) or as boilerplate (a short line with a notice in one of the corpus's four languages). ``clean`` hands on the
documents that stay, without their failing lines. Only SQL expressions are used; a document never leaves its row, so nothing is
shuffled.

Cases: a null text is an empty one (no words, rejected); a line without words is neither kept nor lost, and stays in the text; of
repeated lines only the first counts as kept, though all stay in the text; ties and repeated rows are judged alike; an empty table
gives an empty table; other columns of the input are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import let

SPACES = r"[\x20\x09-\x0D]+"
#: A document fails at once below this number of words, or if more than this share of its words stand in repeated windows.
MIN_WORDS, MAX_REPEATED_PCT = 50, 50
#: A document that loses more than this share of its word characters with the failing lines is rejected.
MAX_LOST = 0.4
#: A line fails above these shares: symbols and bars per word, words in capitals, exclamation marks per word.
MAX_SYMBOLS_PER_WORD, MAX_CAPITAL_WORDS, MAX_MARKS_PER_WORD = 0.3, 0.7, 0.5
#: Lines of at least this many words are judged for capitals and marks; shorter ones say too little.
JUDGED_WORDS = 3
#: A line of fewer words that doesn't end a sentence fails, and one of at most so many words with a notice.
UNENDED_WORDS, NOTICE_WORDS = 10, 12
#: Lower-case phrases of lines that no article text has, in English, German, French and Spanish.
BOILERPLATE = (
    "cookie", "javascript", "lorem ipsum", "newsletter",
    "all rights reserved", "terms of use", "privacy policy", "sign in", "log in", "subscribe to",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz", "impressum", "anmelden",
    "tous droits réservés", "conditions d'utilisation", "mentions légales", "confidentialité", "se connecter",
    "todos los derechos reservados", "términos de uso", "aviso legal", "política de privacidad", "iniciar sesión",
)
NAVIGATION = r"[|»›•>]"
#: What a sentence ends with, and what may follow it.
ENDED = r"""[.!?:;\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*[\x20\x09-\x0D]*\z"""
_BLANK, _WORD, _SYMBOL = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words_of(text: Column) -> Column:
    """Runs of other than blank characters, in order."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text."""

    def marked(windows: Column) -> Column:
        # Sorted (hash, place) pairs: a window is repeated if a neighbour has the same hash.
        def places(s: Column) -> Column:
            n = F.size(s)
            twin = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])),
            )
            starts = F.sort_array(F.transform(twin, lambda x: x["i"]))
            # Each start covers three words, less what the next start covers as well.
            return let(
                starts,
                lambda p: F.aggregate(
                    p,
                    F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                    lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
                    lambda a: a["n"],
                ),
            )

        return F.when(F.size(F.array_distinct(F.transform(windows, lambda x: x["h"]))) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(windows), places)
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(
            F.transform(
                F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
            ),
            marked,
        )
    )


def line_facts(line: Column) -> Column:
    """Word characters and the verdict of one line. The rules that cost most come last, and only if those before let the line pass."""
    size = F.struct(F.size(words_of(line)).alias("words"), (F.char_length(line) - count(line, _BLANK)).alias("chars"))

    def verdict(x: Column) -> Column:
        words, judged = x["words"], x["words"] >= JUDGED_WORDS
        low = F.lower(line)
        notice = F.lit(False)
        for phrase in BOILERPLATE:
            notice = notice | low.contains(phrase)
        shouts = line.rlike(r"\p{Lu}{2}|\p{Lu}[!?]{2}") & (count(line, r"(?<![^\s])\p{Lu}{2,}(?![^\s!?.,;:])|(?<![^\s])\p{Lu}(?=[!?]{2})") > MAX_CAPITAL_WORDS * words)
        bars = let(count(line, NAVIGATION), lambda n: (n >= 2) & (n > MAX_SYMBOLS_PER_WORD * words))
        bad = (
            (count(line, _SYMBOL) > MAX_SYMBOLS_PER_WORD * words)
            | bars
            | (judged & (count(line, "[!?]") > MAX_MARKS_PER_WORD * words))
            | (judged & shouts)
            | ((words <= NOTICE_WORDS) & notice)
            | ((words < UNENDED_WORDS) & ~line.rlike(ENDED))
        )
        return F.struct(x["chars"].cast("long").alias("chars"), ((words == 0) | ~bad).alias("good"))

    return let(size, verdict)


def facts_of(text: Column) -> Column:
    """All counts of a text, and its text without failing lines."""

    def of_lines(lines: Column) -> Column:
        def of_distinct(distinct: Column) -> Column:
            def summed(facts: Column) -> Column:
                bad = F.filter(F.transform(distinct, lambda x, i: F.when(~F.get(facts, i)["good"], x)), lambda x: x.isNotNull())
                return F.struct(
                    F.aggregate(facts, F.lit(0).cast("long"), lambda a, x: a + F.when(x["good"], x["chars"]).otherwise(0)).alias("kept_chars"),
                    let(bad, lambda b: F.when(F.size(b) == 0, text).otherwise(F.array_join(F.filter(lines, lambda x: ~F.array_contains(b, x)), "\n"))).alias("cleaned"),
                )

            return let(F.transform(distinct, line_facts), summed)

        worded = F.filter(lines, lambda x: x.rlike(_WORD))
        return let(
            worded, lambda ws: let(F.array_distinct(ws), lambda ds: F.struct((F.size(ws) - F.size(ds)).cast("long").alias("n_dup_lines"), of_distinct(ds).alias("kept")))
        )

    return F.struct(
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        (F.char_length(text) - count(text, _BLANK)).cast("long").alias("word_chars"),
        count(text, _SYMBOL).cast("long").alias("n_symbols"),
        let(F.split(text, "\n", -1), of_lines).alias("l"),
    )


def judge(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the base counts, the share of word characters lost with failing lines, both verdicts and cleaned_text."""
    facts = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(*keys, facts_of(F.col("_t")).alias("f"))
    flat = facts.select(*keys, "f.w.n_words", "f.word_chars", "f.n_symbols", "f.l.n_dup_lines", "f.w.n_repeat_words", "f.l.kept.kept_chars", F.col("f.l.kept.cleaned").alias("cleaned_text"))
    lost = F.when(F.col("word_chars") == 0, 1.0).otherwise(1.0 - F.col("kept_chars") / F.greatest("word_chars", F.lit(1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words"))
    return flat.withColumn("lost_share", lost).withColumn("base_failed", failed).withColumn("kept", ~failed & (lost <= MAX_LOST))


def clean(docs: DataFrame, remove_lines: bool = True) -> DataFrame:
    """The documents that pass, with all their columns; text without its failing lines, and n_chars, if there is one, of that text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = judge(docs.select(row.alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text")), "_text", ("_row",)).where("kept")
    new = {"text": F.col("cleaned_text"), "n_chars": F.char_length("cleaned_text")} if remove_lines else {}
    types = dict(docs.dtypes)
    return kept.select(*[(new[c].cast(types[c]) if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from inkwell.llm.common import table

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_share", 6).alias("lost_share")
    )
