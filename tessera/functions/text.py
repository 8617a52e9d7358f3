"""Scalar text functions as Column expressions: JVM-side, within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in questions about facts.
FACT_STOPWORDS = ("the", "and", "did", "what", "when", "was", "for", "you", "your", "with", "have")


def tokens(s: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes and more."""
    return F.filter(F.split(F.lower(s), "[^\\p{L}\\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def ascii_tokens(s: Column, least: int = 2) -> Column:
    """Lower-cased runs of ASCII letters, digits and apostrophes."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9']+"), F.lit(0)), lambda t: F.length(t) >= least)


def brief_tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 4))


def fact_terms(s: Column) -> Column:
    got = F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(*FACT_STOPWORDS))
    return F.array_distinct(got)


def base_var(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def slug(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(s)), "[^\\p{L}\\p{Nd}]+", "-"), F.lit("-"))


def split_camel(s: Column) -> Column:
    return F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def strip_html(s: Column) -> Column:
    """Style, script and comments dropped, tags to spaces, white space collapsed; references stay."""
    s = F.regexp_replace(s, "(?is)<style[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, "(?is)<script[^>]*>.*?</script>", " ")
    s = F.regexp_replace(s, "(?s)<!--.*?-->", " ")
    return collapse(F.regexp_replace(s, "<[^>]+>", " "))


def classify_origin(s: Column) -> Column:
    """The kind of source that an origin names; the first of these tests that holds."""
    low = F.lower(s)
    return (
        F.when(low.contains("wikipedia") | low.contains("zim"), "wikipedia")
        .when(low.contains("arxiv"), "arxiv")
        .when(low.contains("doi.org") | low.contains("doi:"), "doi")
        .when(low.contains("isbn"), "book")
        .when(low.contains("manual") | low.contains("direct"), "manual")
        .otherwise("other")
    )


def first_sentence(s: Column) -> Column:
    got = F.regexp_extract(s, "(?s)^(.*?[.!?])(\\s|$)", 1)
    return F.when(got == "", s).otherwise(got)


def pct(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def map_resolution(s: Column) -> Column:
    return F.when(s.isin("corroborated", "challenged"), "confirmed").when(s == "irrelevant", "ambiguous").when(s == "no_signal", "refuted").otherwise("unresolved")


def resolution_rank(s: Column) -> Column:
    return F.when(s == "corroborated", 3).when(s.isin("irrelevant", "challenged"), 2).when(s == "no_signal", 1).otherwise(0)


def digest(s: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(s, 256), 1, n)


def verified_quote(source: Column, quote: Column, least: int = 20) -> Column:
    """Whether the quote, white space and case aside, is in the source."""
    norm = lambda c: F.lower(collapse(c))
    return (F.length(quote) >= least) & F.contains(norm(source), norm(quote))


#: Words that no keyword question means.
KEYWORD_STOPWORDS = (
    "a an and are as at be but by did do does for from had has have he her his i if in is it its me my not of on or our she so that the their them they "
    "this to was we were what when where which who will with you your about how many list all exist"
).split()
#: Words that a depth query leaves out.
NOISE = "the of and in a is for to as by an on or that with".split()
FILLER = "thesis hypothesis framing typology theory classification reframing framework model approach perspective".split()
#: Phrasings of instructions within a source, redacted before a model reads it.
INJECTIONS = (
    r"ignore\s+(?:all\s+|the\s+|these\s+|your\s+|previous\s+|prior\s+|above\s+|preceding\s+)*(?:instructions?|prompts?|rules?|constraints?|directives?)",
    r"disregard\s+(?:all\s+|the\s+|these\s+|your\s+|previous\s+|prior\s+|above\s+|preceding\s+)*(?:instructions?|prompts?|rules?)",
    r"forget\s+(?:all\s+|everything\s+|the\s+|these\s+|previous\s+|prior\s+|above\s+|your\s+)*",
    r"you\s+are\s+now\s+(?:a|an|the)\s+",
    r"system\s*:\s*(?:you|ignore|your)",
    r"<\s*/?\s*(?:system|user|assistant|human|instructions?)\s*>",
    r"\[\s*/?\s*(?:INST|SYSTEM|USER|ASSISTANT)\s*\]",
    r"new\s+(?:instructions?|system\s+prompt|rules?)\s*:",
    r"override\s+(?:all\s+|previous\s+|above\s+|prior\s+)*(?:instructions?|rules?|prompts?)",
    r"act\s+as\s+(?:a|an|the)\s+(?:different|new)\s+",
    r"respond\s+with\s+(?:only|just)\s+[\"']?(?:corroborated|challenged|irrelevant)[\"']?",
)
INJECTION = "(?i)(" + "|".join(INJECTIONS) + ")"
PUNCTUATION = ".,;:\"'()-/"
LABELS = ("irrelevant", "corroborated", "challenged")
#: A token of more than two bytes before a full stop: an end of sentence, not an abbreviation.
SENTENCE = r"(?s)^(.*?(?:[^ (]{3}|[^ (][^\x00-\x7F]|[^\x00-\x7F][^ (]|[\x{0800}-\x{10FFFF}])[.?!]) "


def keywords(s: Column) -> Column:
    got = F.transform(F.regexp_extract_all(s, F.lit("[A-Za-z0-9']+"), F.lit(0)), F.lower)
    return F.filter(got, lambda t: (F.length(t) > 2) & ~t.isin(*KEYWORD_STOPWORDS))


def ident_tokens(s: Column) -> Column:
    """Lower-cased words of a camel-case, spaced or dashed name, of two bytes and more."""
    got = F.transform(F.split(F.regexp_replace(s, "([A-Z])", " $1"), "[ _-]"), F.lower)
    return F.array_distinct(F.filter(got, lambda t: F.octet_length(t) > 1))


def fields(s: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(s, "\\s+"), lambda w: w != "")


def depth_query(name: Column) -> Column:
    """Two content words of a concept's name, then what would turn up its rivals."""
    low = lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION)))
    kept = F.filter(fields(name), lambda w: (F.octet_length(low(w)) >= 3) & ~low(w).isin(*NOISE, *FILLER))
    return F.array_join(F.concat(F.slice(kept, 1, 2), F.array(F.lit("alternative"), F.lit("theory"))), " ")


def encyclopedia_query(var_name: Column, name: Column, explains: Column) -> Column:
    """What a name explains, else the name if short, else up to four words of the variable."""
    stem = var_name
    for suffix in ("Thesis", "Framing", "Typology", "Reframing", "Hypothesis"):
        stem = F.regexp_replace(stem, suffix + "$", "")
    words = F.filter(F.split(F.regexp_replace(stem, "([A-Z])", " $1"), " "), lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*NOISE[:10]))
    n = F.size(fields(name))
    return F.when(explains != "", explains).when((n > 0) & (n <= 6), name).otherwise(F.array_join(F.slice(words, 1, 4), " "))


def byte_prefix(s: Column, n: int) -> Column:
    """The longest prefix of whole characters within n bytes."""
    cut = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.regexp_replace(cut, "�$", ""))


def truncate(s: Column, n: int) -> Column:
    """One line of at most n bytes, an ellipsis where it is cut."""
    one = F.translate(s, "\n\r", "  ")
    return F.when(F.octet_length(one) <= n, one).otherwise(F.concat(byte_prefix(one, n), F.lit("…")))


def short_sentence(s: Column, n: int) -> Column:
    """To the first . ! or ? before byte n, else n bytes with an ellipsis."""
    one = F.btrim(F.translate(s, "\n", " "))
    first = F.regexp_extract(one, "^([^.!?]+[.!?])", 1)
    return F.when((first != "") & (F.octet_length(first) <= n), first).when(F.octet_length(one) > n, F.concat(F.btrim(byte_prefix(one, n)), F.lit("…"))).otherwise(one)


def summary_sentence(s: Column) -> Column:
    """First sentence of a text on one line; abbreviations of up to two bytes don't end one."""
    one = collapse(s)
    got = F.regexp_extract(F.concat(one, F.lit(" ")), SENTENCE, 1)
    return F.when((got == "") | (F.length(got) == F.length(one)), one).otherwise(got)


def space_camel(s: Column) -> Column:
    return F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substring(s, 2, 1 << 30), "(\\p{Lu})", " $1"))


def titleize(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def slug_anchor(s: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.regexp_replace(s, "[`*_]+", "")), "[^\\w\\- ]+", "")
    return F.replace(F.btrim(bare), F.lit(" "), F.lit("-"))


def without_fences(s: Column) -> Column:
    """Text without fenced code blocks (one that isn't closed reaches to the end); all of it if nothing is left."""
    got = F.btrim(F.regexp_replace(s, "(?ms)^[ \\t]*(?:```|~~~)[^\\n]*(?:\\n.*?)??(?:\\n[ \\t]*(?:```|~~~)[^\\n]*|\\z)", ""), F.lit(" \n\r\t"))
    return F.when(got == "", s).otherwise(got)


def looks_like_identifier(t: Column) -> Column:
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (F.length(t) >= 4) & (F.lower(t).startswith("arxiv:") | F.lower(t).startswith("doi:") | t.startswith("10.") | ((digits >= 7) & (digits >= F.length(t) - 2)))


def origin_slugs(origin: Column) -> Column:
    """Slugs of an origin's title (after the first " / ") and of the identifiers in it."""
    tail = F.when(F.contains(origin, F.lit(" / ")), F.array(slug(F.substring(origin, F.locate(" / ", origin) + 3, F.lit(1 << 30))))).otherwise(F.array().cast("array<string>"))
    ids = F.filter(F.transform(fields(origin), lambda t: F.btrim(t, F.lit(",.;:()[]{}'\""))), looks_like_identifier)
    return F.concat(tail, F.transform(ids, slug))


def link_key(s: Column) -> Column:
    """A link target's key: as a slug, but with its slashes."""
    got = F.regexp_replace(F.lower(F.trim(s)), "[^\\p{L}\\p{Nd}/]+", "-")
    return F.btrim(F.regexp_replace(got, "/-", "/"), F.lit("-"))


def bare(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def unnegated(s: Column, word: str) -> Column:
    """Whether the word occurs somewhere that isn't preceded by "not" or "no"."""
    parts = F.split(s, word)
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~F.rtrim(p).rlike("(not|no)$"))


def classification(raw: Column) -> Column:
    """The first label after the last "final classification", else the only label that isn't negated, else null."""
    tail = F.regexp_extract(F.lower(raw), "(?s)^.*final classification(.*)$", 1)
    told = F.regexp_extract(tail, f"({'|'.join(LABELS)})", 1)
    found = F.filter(F.array(*[F.when(unnegated(raw, w), w) for w in LABELS]), lambda w: w.isNotNull())
    return F.when(told != "", told).when(F.size(found) == 1, F.get(found, F.lit(0)))


def critic_verdict(s: Column) -> Column:
    """(accept, reason): unclear answers accept; a reason is made one lower-case token of 60 bytes."""
    up, raw = F.upper(s), F.btrim(F.regexp_extract(F.concat(F.lit("\n"), s), "(?i)\\n[ \\t]*reason:([^\\n]*)", 1))
    reason = F.when(raw == "", "unspecified").otherwise(raw)
    reject = ~up.rlike("VERDICT: ?ACCEPT") & up.rlike("VERDICT: ?REJECT")
    return F.struct((~reject).alias("accept"), F.when(reject, byte_prefix(F.lower(F.replace(reason, F.lit(" "), F.lit("_"))), 60)).otherwise("").alias("reason"))


def strip_injection(s: Column) -> Column:
    return F.regexp_replace(s, INJECTION, " [REDACTED:suspected-injection] ")


def year_of(s: Column) -> Column:
    """The year of a date in one of five forms, else 0."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, dd MMM yyyy HH:mm:ss Z", "EEE, dd MMM yyyy HH:mm:ss z", "yyyy-MM-dd")
    day = F.regexp_replace(F.trim(s), "^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.year(F.try_to_timestamp(day, F.lit(f.replace("EEE, ", "")))) for f in forms], F.lit(0))


def one_line(s: Column) -> Column:
    """Control characters but tabs become spaces."""
    return F.regexp_replace(F.regexp_replace(s, "[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{9F}]", " "), "^\\s+|\\s+$", "")


def clean_answer(s: Column) -> Column:
    """Escapes and curly quotes of a model's answer, plain."""
    for a, b in (('\\"', '"'), ("\\n", " "), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, "^\\s+|\\s+$", "")


def pascal_case(s: Column) -> Column:
    words = F.filter(F.transform(fields(s), lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "")), lambda w: w != "")
    got = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    return F.when(got.rlike("^[0-9]"), F.concat(F.lit("X"), got)).otherwise(got)


def identifier(s: Column) -> Column:
    """Letters, digits and underscores alone; empty if it would begin with a digit."""
    got = F.regexp_replace(F.regexp_replace(s, "^[0-9]", ""), "[^A-Za-z0-9_]", "")
    return F.when(got.rlike("^[0-9]"), "").otherwise(got)


def role_of_kind(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.isin("person", "organization", "concept", "hypothesis", "event", "place"), F.initcap(low)).otherwise("")


def actor(s: Column, markers: tuple[str, ...] = ("metabolism", "agent", "bot", "process", "sensor", "ingest"), own: str = "engine") -> Column:
    """human:<id>, or process:<id> where a marker (or the engine's own name) says so; none is the engine."""
    who = F.btrim(s)
    return F.when(who == "", "process:" + own).when(F.lower(who).rlike("|".join((*markers, own))), F.concat(F.lit("process:"), who)).otherwise(F.concat(F.lit("human:"), who))


def resource(origin: Column, ident: Column) -> Column:
    """The first URL of an origin, else a name in a scheme of our own."""
    url = F.regexp_extract(origin, "(https?://[^\\s,)]+)", 1)
    return F.when(url != "", F.rtrim(url, F.lit(".,;"))).otherwise(F.concat(F.lit("source:"), ident))


def first_line_with(s: Column, needle: str, n: int = 240) -> Column:
    line = F.btrim(F.get(F.filter(F.split(s, "\n"), lambda x: x.contains(needle)), F.lit(0)))
    return F.coalesce(F.when(F.octet_length(line) > n, F.concat(byte_prefix(line, n), F.lit("..."))).otherwise(line), F.lit(""))


def any_term(s: Column, query: str) -> Column:
    """Whether a word of four bytes and more of the query is in the text; an empty query fits all."""
    if not query:
        return F.lit(True)
    words = [w.strip(PUNCTUATION) for w in query.lower().split()]
    out = F.lit(False)
    for w in words:
        if len(w.encode()) >= 4:
            out = out | F.lower(s).contains(w)
    return out


#: Stems of the knowledge base's domain.
DOMAIN_STEMS = (
    "mind", "cogniti", "conscious", "perception", "belief",
    "epistem", "knowledge", "theory", "hypothesis", "philosophy",
    "psycholog", "neurosci", "brain", "reason", "bias",
    "logic", "proof", "theorem", "formal", "mathematical",
    "language", "semanti", "meaning", "concept",
    "evidence", "experiment", "empirical", "observation",
    "predict", "model", "framework", "paradigm",
    "critic", "dispute", "debate", "argue", "reject",
    "propose", "claim", "assert", "contend",
    "phenomeno", "qualia", "subjective", "experience",
    "schizophreni", "apopheni", "pattern", "hallucin",
    "nondual", "mystical", "meditation", "awareness",
    "universal", "innate", "evolution", "adapt",
    "impact", "explosion", "crater", "asteroid", "comet", "tunguska",
)


def relevant(snippet: Column, title: Column, brief: Column, stems: tuple[str, ...] = DOMAIN_STEMS) -> Column:
    """Whether a paper is worth a closer look: it has no snippet, or snippet and title hold a stem or a word of five bytes and more of the brief."""
    text = F.lower(F.concat_ws(" ", snippet, F.coalesce(title, F.lit(""))))
    words = F.filter(F.split(F.lower(F.coalesce(brief, F.lit(""))), r"(?U)\s+"), lambda w: F.octet_length(w) >= 5)
    return (F.coalesce(snippet, F.lit("")) == "") | F.exists(F.array(*[F.lit(s) for s in stems]), lambda s: F.contains(text, s)) | F.exists(words, lambda w: F.contains(text, w))


def contains_term(text: Column, term: str, exclusions: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether the text holds the term, unless it holds one of the phrases that excuse the term."""
    out = F.contains(text, F.lit(term))
    for phrase in (exclusions or {}).get(term, ()):
        out = out & ~F.contains(text, F.lit(phrase))
    return F.coalesce(out, F.lit(False))


def fabricated(name: Column, kind: Column, hints: tuple[str, ...]) -> Column:
    """Why a proposed name can't be one; empty if it can. The hints tell notes about a source from names."""
    n, low = F.btrim(name), F.lower(F.btrim(name))
    return F.when(n == "", "empty").when(F.octet_length(n) > 80, "too_long").when(low.rlike("|".join(hints)), "meta_annotation").when((F.lower(kind) == "organization") & low.contains(" et al"), "et_al_as_org").otherwise("")


def quote_found(source: Column, quote: Column) -> Column:
    """Whether a quote of 20 characters and more, or its first or middle 40, is in the source; white space and case aside."""
    norm = lambda c: F.lower(collapse(c))
    s, q = norm(source), F.btrim(norm(quote), F.lit("\"'"))
    n = F.length(q)
    part = F.least(F.lit(40), n)
    mid = F.floor(n / 2).cast("int")
    return (n >= 20) & (F.contains(s, q) | F.contains(s, F.substring(q, F.lit(1), part)) | ((mid + part <= n) & F.contains(s, F.substring(q, mid + 1, part))))


def history_bucket(resolution: Column, queried: Column) -> Column:
    return F.when(~queried, 0).when(resolution == "", 1).when(resolution.isin("irrelevant", "challenged"), 2).when(resolution == "no_signal", 3).when(resolution == "corroborated", 4).otherwise(1)


def drift(old: Column, new: Column, old_digest: Column, new_digest: Column) -> Column:
    """How a verdict moved; an equal verdict of a changed oracle is told apart."""
    changed = (old_digest != "") & (new_digest != "") & (old_digest != new_digest)
    return F.when(new == "unresolvable", "unresolvable").when((new == old) & changed, "resolver_changed").when(new == old, "stable").when(new == "confirmed", "flipped_to_confirmed").when(new == "refuted", "flipped_to_refuted").otherwise("now_ambiguous")


def profile(temperature: Column, prompt: Column) -> Column:
    heat = F.when(temperature >= 0.9, "psychedelic").when(temperature >= 0.6, "exploratory").when(temperature >= 0.3, "microdose").otherwise("sober")
    kinds = {"analogy": "pattern-matching", "contradiction": "adversarial", "genealogy": "causal-tracing", "prediction": "forecasting", "confluence": "convergence", "synthesis": "concept-genesis"}
    what = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), prompt), F.lit(""))
    return F.concat(heat, F.lit("/"), what)


def lint_failed(s: Column) -> Column:
    return F.exists(F.split(s, "\n"), lambda x: (x.contains("FAIL") & x.contains("naming-oracle")) | (x.contains("value-conflict") & x.contains("CONFLICT")))


def gap_status(prediction_type: Column, found: Column, novel: Column, total: Column) -> Column:
    """Whether a cycle's papers are news to the knowledge base; empty for types that don't search."""
    return F.when((prediction_type != "") & (prediction_type != "structural_fragility"), "").when(found == 0, "no_signal").when(novel == 0, "no_gap").when(novel == total, "gap_confirmed").otherwise("mixed_overlap")


def novel(title: Column, ident: Column, known: Column) -> Column:
    """Whether neither slug of a paper is among the known ones."""
    a, b = slug(title), slug(ident)
    return ~(((a != "") & F.array_contains(known, a)) | ((b != "") & F.array_contains(known, b)))


#: Words that begin no name, and where a brief's leading clause ends.
NAME_STOPWORDS = "the a an and or but of to in on at for is are was were be as by from into via that this it its with we our".split()
CLAUSE_END = r":|\. |; | — | - | \("
#: Words that a sensor's query leaves out.
SENSOR_STOPWORDS = (
    "the of and in a is for to as by an on at or that this with from are was were been have has had its his her their our which can not but all "
    "there exists every each some many most more only such also than may would does into when how what about between through"
).split()
SENSOR_FILLER = [*FILLER, "central", "claim", "argument", "proposal"]
_TRIMMED = ".,;:—-()\"'"


#: Letters whose upper case is several letters in full, and the one letter that each has (itself, if none).
_LONG_UPPER = "".join(c for c in map(chr, range(0xFFFF)) if len(c.upper()) > 1)
_ONE_UPPER = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _LONG_UPPER)


def upper_letter(c: Column) -> Column:
    """A letter's upper case, of one letter always."""
    return F.when(F.contains(F.lit(_LONG_UPPER), c), F.translate(c, _LONG_UPPER, _ONE_UPPER)).otherwise(F.upper(c))


def derive_names(brief: Column, stamp: Column) -> tuple[Column, Column]:
    """A variable's name and a display name from up to four content words of a brief's leading clause; a note of the stamp if it has none."""
    clean = lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "")
    first_up = lambda w: F.concat(upper_letter(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    words = F.filter(fields(F.split(F.coalesce(brief, F.lit("")), CLAUSE_END, 2)[0]), lambda w: (F.length(clean(w)) >= 3) & ~F.lower(clean(w)).isin(*NAME_STOPWORDS))
    words = F.slice(words, 1, 4)
    name = identifier(F.array_join(F.transform(words, lambda w: first_up(clean(w))), ""))
    shown = first_up(F.array_join(F.transform(words, lambda w: F.btrim(w, F.lit(_TRIMMED))), " "))
    note = lambda text, form: F.concat(F.lit(text), F.date_format(stamp, form))
    return F.when(name == "", note("Note", "yyyyMMddHHmmss")).otherwise(name), F.when(name == "", note("Note ", "yyyy-MM-dd")).otherwise(shown)


def sensor_query(var_name: Column, name: Column, brief: Column, proposer: Column) -> Column:
    """Up to four search words: the proposer's surname, the concept's words, then those of its brief, then of its variable."""
    same = lambda a, b: F.lower(a) == F.lower(b)
    words = lambda s: fields(F.coalesce(s, F.lit("")))
    camel = lambda s: words(F.regexp_replace(s, "([A-Z])", " $1"))
    telling = lambda w: (F.octet_length(w) >= 4) & ~F.lower(w).isin(*SENSOR_STOPWORDS, *SENSOR_FILLER)
    content = lambda s: F.filter(F.transform(words(s), lambda w: F.btrim(w, F.lit(PUNCTUATION))), telling)
    surname = F.slice(F.reverse(words(proposer)), 1, 1)
    stem = var_name
    for suffix in ("Thesis", "Framing", "Typology", "Reframing"):
        stem = F.regexp_replace(stem, suffix + "$", "")
    of_stem = F.filter(camel(stem), lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*SENSOR_STOPWORDS))
    concept = F.when(F.size(words(name)).between(1, 6), content(name)).otherwise(of_stem)
    parts = F.concat(surname, F.slice(F.filter(concept, lambda w: ~F.exists(surname, lambda p: same(p, w))), F.lit(1), 3 - F.size(surname)))
    extend = lambda acc, w: F.when((F.size(acc) >= 4) | F.exists(acc, lambda p: same(p, w)), acc).otherwise(F.concat(acc, F.array(w)))
    parts = F.when(F.size(parts) < 3, F.aggregate(content(brief), parts, extend)).otherwise(parts)
    parts = F.when(F.size(parts) < 2, F.concat(parts, F.filter(camel(var_name), telling))).otherwise(parts)
    return F.array_join(F.slice(parts, 1, 4), " ")
