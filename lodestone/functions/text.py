"""Text column functions: normalisers, tokens, sentences, redaction, identifiers. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns (fixed values).
EMAIL = r"[\w.+\-]+@[\w\-]+\.(?:[a-zA-Z]{2,})"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
PHONE = r"(?<!\d)(?:\+(?:91|44|1)[\s\-]|(?:91|44)-|0(?=\d))\d[\d\s\-]{7,10}\d(?!\d)"
CREDENTIAL = r"(?i)(?:password|passwd|pwd|secret|api[_\-]?key|token|credential|private[_\-]?key)\s*[:=]\s*\S+"
IDENTIFIER = r"(?i)(?:ssn|social\s+security|credit\s+card|card\s+number|pan\s+number|aadhaar)"
#: An e-mail address that is not the name of a key exchange.
GUARDED_EMAIL = r"(?i)(?<![\w@])(?!(?:[0-9a-f]{8,}|[\w\d]+-sha[0-9]+|sntrup|mlkem|kyber|dilithium|sphincs|falcon)[^\s]*@)[a-zA-Z0-9][\w.+\-]{1,}@[\w\-]+\.(?:[a-zA-Z]{2,})"
TOKEN = r"\b[a-zA-Z0-9_\-]{3,}\b"
CONTROL_ID = r"(?i)\bVAPT-\d+\b|\b\d+\.\d+(?:\.\d+)?\b"
INJECTION_PHRASES = ["ignore previous instructions", "ignore all previous", "system prompt", "you are now", "disregard the above", "act as", "override instructions"]
STALE = ["expired", "deprecated", "decommissioned", "no longer valid", "no longer used", "no longer in use", "superseded", "obsolete", "discontinued", "retired", "end of life", "end-of-life", "sunset", "not in use"]
#: Words that carry no meaning of their own (fixed values).
STOPWORDS = "the a an and or but in on at to for of with is are was were be been being has have had do does did will would could should may might shall can not no yes it its this that these those from as by into which who what when where how all any both".split()
MARKUP_BLOCKS = r"(?is)<(script|style|head|meta)\b.*?</\1\s*>|<meta\b[^>]*>"


def collapse(text: Column) -> Column:
    """White space to single spaces, curly quotes to straight ones, trimmed, in lower case."""
    return F.lower(F.trim(F.translate(F.regexp_replace(text, r"\s+", " "), "“”‘’", "\"\"''")))


def alphanumeric(text: Column) -> Column:
    """Lower-case letters a-z, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def ranking_tokens(text: Column) -> Column:
    """The tokens that ranking counts: runs of three or more ASCII letters, digits, _ and -, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column, min_words: int = 4) -> Column:
    """Sentences of at least ``min_words`` words; the whole text if there is none."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    kept = F.filter(parts, lambda s: F.size(F.split(s, r"\s+")) >= min_words)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


def paragraphs(text: Column, min_words: int = 8, longest: int = 800, min_line_words: int = 4) -> Column:
    """Paragraphs of ``min_words`` words; those longer than ``longest`` characters become their lines of ``min_line_words`` words."""

    def words(x: Column) -> Column:
        return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))

    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: words(p) >= min_words)
    split = F.transform(parts, lambda p: F.when(F.char_length(p) > longest, F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: words(x) >= min_line_words)).otherwise(F.array(p)))
    return F.flatten(split)


def strip_markup(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and head go, tags become spaces, white space collapses."""
    bare = F.regexp_replace(F.regexp_replace(html, MARKUP_BLOCKS, " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def redact(text: Column, addresses: bool = True) -> Column:
    """E-mail addresses, then IPv4 addresses (unless ``addresses`` is false), then phone numbers."""
    out = F.regexp_replace(text, EMAIL, "[EMAIL REDACTED]")
    if addresses:
        out = F.regexp_replace(out, IPV4, "[IP REDACTED]")
    return F.regexp_replace(out, PHONE, "[PHONE REDACTED]")


def has_personal_data(text: Column) -> Column:
    return text.rlike(GUARDED_EMAIL) | text.rlike(CREDENTIAL) | text.rlike(IDENTIFIER)


def token_estimate(text: Column) -> Column:
    """Four characters to a token."""
    return F.floor(F.char_length(text) / 4).cast("long")


def chunk_id(file: Column, index: Column, sentence: Column, content: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", file, index.cast("string"), sentence.cast("string"), content)), 1, 8)


def grounded(quote: Column, document: Column) -> Column:
    """GROUNDED if the first 50 characters of the quote, without quotes around them, are in the document."""
    head = F.trim(F.lower(F.substring(quote, 1, 50)))
    head = F.btrim(head, F.lit("\"'“”"))
    found = (head != "") & F.contains(F.lower(document), head) & (quote != "NOT_FOUND")
    return F.when(F.coalesce(found, F.lit(False)), "GROUNDED").otherwise("NOT_GROUNDED")


def graded_grounding(quote: Column, chunk: Column, document: Column, min_words: int = 6) -> Column:
    """How a quote is found: in the chunk, the document, the bare alphanumeric document, or by its longest word prefix."""
    q, words = collapse(quote), F.split(alphanumeric(quote), " ")
    bare = alphanumeric(document)
    prefixes = F.when(F.size(words) >= min_words, F.transform(F.sequence(F.size(words), F.lit(min_words), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))
    return (
        F.when(F.coalesce(q, F.lit("")) == "", "EMPTY")
        .when(F.contains(collapse(chunk), q), "CHUNK")
        .when(F.contains(collapse(document), q), "DOCUMENT")
        .when(F.contains(bare, alphanumeric(quote)), "ALPHANUMERIC")
        .when(F.exists(prefixes, lambda p: F.contains(bare, p)), "PREFIX")
        .otherwise("NOT_GROUNDED")
    )


def control_ids(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CONTROL_ID), F.lit(0)), lambda x: F.upper(x)))


def citations(text: Column) -> Column:
    """File names cited in a cell: parts between ; and line ends, without [tags], that look like names."""
    parts = F.transform(F.split(text, r"[;\n]"), lambda p: F.trim(F.regexp_replace(p, r"\[[^\]]*\]", "")))
    return F.filter(parts, lambda p: p.rlike(r"(?i)^[^/\\:*?\"<>|]{1,200}\.(?:pdf|docx?|xlsx?|csv|pptx?|txt|png|jpe?g|xml|json|html?)$"))


def injection_phrases(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in INJECTION_PHRASES]), lambda p: F.contains(F.lower(text), p))


def duration_text(seconds: Column) -> Column:
    """1h 2m 3.4s; hours and minutes only where there are any."""
    h, m = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    s = F.format_string("%.1fs", F.pmod(seconds, F.lit(60.0)).cast("double"))
    return F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))), s)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for a row and not again at each place where ``body`` has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int) -> Column:
    """The runs of ``n`` words, joined by spaces."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return bound(words, runs)


def unsupported_claims(reasoning: Column, document: Column, n: int = 3) -> Column:
    """Sentences of ``reasoning`` with no ``n``-gram in the document (both as bare words)."""

    def unseen(s: Column, bare: Column) -> Column:
        grams = ngrams(F.split(alphanumeric(s), " "), n)
        return (F.size(grams) > 0) & ~F.exists(grams, lambda g: F.contains(bare, F.concat(F.lit(" "), g, F.lit(" "))))

    return bound(F.concat(F.lit(" "), alphanumeric(document), F.lit(" ")), lambda bare: F.filter(sentences(reasoning), lambda s: unseen(s, bare)))


def term_overlap(terms: Column, document: Column) -> Column:
    """Share of ``terms`` that the document contains; null without terms."""
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(document), t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms))


def quote_terms(quote: Column) -> Column:
    """The key terms of a quote, each as often as the quote has it."""
    words = F.regexp_extract_all(F.lower(quote), F.lit(r"\b[a-z0-9]{3,}\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def terms_grounded(quote: Column, document: Column, least_terms: int = 3, share: float = 0.60) -> Column:
    """Whether a document has ``share`` of a quote's key terms, each as often as the quote has it; never for fewer than ``least_terms``."""
    return F.coalesce(bound(quote_terms(quote), lambda t: (F.size(t) >= least_terms) & (term_overlap(t, document) >= share)), F.lit(False))


def unsafe(text: Column, longest: int = 5000) -> Column:
    """True for texts that are too long or hold tags or control characters."""
    return (F.char_length(text) > longest) | text.rlike(r"<[^>]+>") | text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def stale(text: Column) -> Column:
    """True if a phrase says that the text is out of date."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p) for p in STALE]), lambda p: F.contains(low, p))


def key_terms(text: Column) -> Column:
    """Words of three or more letters or digits that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z0-9]{3,}\b"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def date_grounded(date: Column, document: Column) -> Column:
    """True if the document has the date's four-digit year and one of its shorter numbers (each where the date has any)."""
    numbers = F.regexp_extract_all(date, F.lit(r"\d+"), F.lit(0))
    years, others = F.filter(numbers, lambda x: F.char_length(x) == 4), F.filter(numbers, lambda x: F.char_length(x) <= 2)

    def found(tokens: Column) -> Column:
        return (F.size(tokens) == 0) | F.exists(tokens, lambda x: F.contains(document, x))

    return F.coalesce((F.size(numbers) > 0) & (document != "") & found(years) & found(others), F.lit(False))


def whole_sentence(prefix: Column, document: Column, longest: int = 450, mark: bool = True) -> Column:
    """The document's text from ``prefix`` to the end of its sentence, line block or ``longest`` more characters; the prefix if it isn't there.

    The mark that ends the sentence stays out if ``mark`` is false; marks of the prefix stay.
    """
    at = F.position(prefix, document)
    rest = F.substring(document, at + F.char_length(prefix), F.lit(longest))
    end = r"[.!?](?=[\t\n\f\r ]|\z)"
    tail = F.regexp_extract(rest, rf"(?s)^(.*?(?:{end}|(?=\n\n)|\z))" if mark else rf"(?s)^(.*?)(?:{end}|\n\n|\z)", 1)
    return F.when(at > 0, F.concat(F.substring(document, at, F.char_length(prefix)), tail)).otherwise(prefix)


def window_around(document: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The characters from ``before`` before ``start`` to ``after`` after ``end`` (offsets from 0)."""
    first = F.greatest(F.lit(0), start - before)
    return F.substring(document, first + 1, end + after - first)
