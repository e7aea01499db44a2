"""Text as columns: cleaning, names, tokens, markup, keys and JSON repair. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question, and in a chapter's name.
QUESTION_STOP_WORDS = ("what", "is", "are", "the", "a", "an", "in", "on", "at", "to")
NAME_STOP_WORDS = ("and", "of", "the", "in", "a")

# Markup commands and the symbols they stand for, in the order of replacement.
SYMBOLS = (
    (r"\times", "×"), (r"\div", "÷"), (r"\pm", "±"), (r"\mp", "∓"), (r"\leq", "≤"), (r"\geq", "≥"), (r"\neq", "≠"), (r"\approx", "≈"),
    (r"\infty", "∞"), (r"\therefore", "∴"), (r"\because", "∵"), (r"\rightarrow", "→"), (r"\leftarrow", "←"), (r"\Rightarrow", "⇒"),
    (r"\degree", "°"), (r"\circ", "°"), (r"\alpha", "α"), (r"\beta", "β"), (r"\gamma", "γ"), (r"\delta", "δ"), (r"\epsilon", "ε"),
    (r"\theta", "θ"), (r"\lambda", "λ"), (r"\mu", "μ"), (r"\pi", "π"), (r"\sigma", "σ"), (r"\omega", "ω"), (r"\Omega", "Ω"),
    (r"\phi", "φ"), (r"\psi", "ψ"), (r"\rho", "ρ"), (r"\tau", "τ"), (r"\Delta", "Δ"), (r"\nabla", "∇"), (r"\sum", "Σ"), (r"\prod", "Π"),
)
NAMED_FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "sec", "csc", "cot")

# Parts of messages that mark an error worth another try.
RETRYABLE = ("429", "resource_exhausted", "quota", "rate", "503", "500", "overloaded", "timeout", "unavailable")


def contains(column: Column, term: Column | str) -> Column:
    """Case-insensitive containment; % and _ in the term are ordinary characters."""
    return F.lower(column).contains(F.lower(F.lit(term) if isinstance(term, str) else term))


def word_pattern(name: Column, words: int = 3) -> Column:
    """A LIKE pattern of the first long words of a name, in order: %w1%w2%w3%."""
    long = F.slice(F.filter(F.split(F.trim(name), r"\s+"), lambda w: F.length(w) > 2), 1, words)
    return F.concat(F.lit("%"), F.array_join(long, "%"), F.lit("%"))


def clean_text(text: Column, banner: str | None = None, page_mark: str | None = None) -> Column:
    """NUL goes; three and more line feeds, with white space between them or not, become two; runs of spaces and tabs become one space; a page number before page_mark
    goes with it, and so does a banner from its first to its last word on one line; ends are trimmed. Markers are regular expressions."""
    steps = [(r"\x00", ""), (r"\n\s*\n\s*\n\s*", "\n\n"), (r"[ \t]+", " ")]
    steps += [(r"(?U)\d+\s*" + page_mark, "")] if page_mark else []
    steps += [("(?i)" + banner, "")] if banner else []
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")


def normalize_name(name: Column) -> Column:
    """One space between words and "and" for an ampersand."""
    space = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(space(F.replace(F.replace(space(F.trim(name)), F.lit(" & "), F.lit(" and ")), F.lit("&"), F.lit(" and "))))


def significant_words(name: Column) -> Column:
    return F.array_except(F.split(F.lower(normalize_name(name)), " "), F.array(*map(F.lit, NAME_STOP_WORDS)))


def question_words(question: Column) -> Column:
    """Lower-case words of three ASCII letters and more without stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*QUESTION_STOP_WORDS))


def has_devanagari(text: Column) -> Column:
    return text.rlike("[\\u0900-\\u097F]")


def class_number(grade: Column) -> Column:
    """The first number in a grade, else 10."""
    found = F.regexp_extract(grade, r"(\d+)", 1)
    return F.when(found == "", "10").otherwise(F.coalesce(found, F.lit("10")))


def file_name(title: Column, kind: str) -> Column:
    return F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit(f".{kind}"))


def option_text(option: Column) -> Column:
    """An option without its own label such as A) or B."""
    return F.trim(F.regexp_replace(option, r"^[A-F][).\s]+\s*", ""))


def option_label(n: Column) -> Column:
    """A to F for 1 to 6, then numbers."""
    return F.when(n <= 6, F.substring(F.lit("ABCDEF"), n.cast("int"), F.lit(1))).otherwise(n.cast("string"))


def is_correct(option: Column, label: Column, answer: Column, text_too: bool = True) -> Column:
    """By the answer's first letter, or by the whole text. An answer that begins with "Both" marks option B, as it always has."""
    letter = F.upper(F.trim(answer)).startswith(label)
    return F.coalesce((F.trim(answer) != "") & (letter | (F.trim(option) == F.trim(answer)) if text_too else letter), F.lit(False))


def _mapped(text: Column, parts: str, use: Callable[[Column], Column]) -> Column:
    """A text cut into parts by an expression that matches everywhere, each replaced by what `use` makes of it."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(parts), F.lit(0)), lambda p: use(p)), "")


def _symbol(part: Column) -> Column:
    """A command by its symbol, or by its name where it is a function; of several that it begins with the first in order."""
    table = [*SYMBOLS, *(("\\" + f, f) for f in NAMED_FUNCTIONS)]
    return F.coalesce(*[F.when(part.startswith(c), F.concat(F.lit(to), F.substring(part, F.lit(len(c) + 1), F.length(part)))) for c, to in table], part)


def _grouped(part: Column) -> Column:
    """A command with its groups: a fraction as (a/b), a root as √(a), words as they are."""
    group = lambda i: F.get(F.split(part, "[{}]"), F.lit(2 * i - 1))
    fraction, root = F.concat(F.lit("("), group(1), F.lit("/"), group(2), F.lit(")")), F.concat(F.lit("√("), group(1), F.lit(")"))
    words = part.startswith("\\text{") | part.startswith("\\mathrm{") | part.startswith("\\mathbf{")
    return F.when(part.startswith("\\frac{"), fraction).when(part.startswith("\\sqrt{"), root).when(words, group(1)).otherwise(part)


def _formula(text: Column, up: tuple[str, str], down: tuple[str, str], single: bool) -> Column:
    """Formulas in four passes: symbols, commands with groups, then what is raised or lowered (groups first, then what is in
    them; without `single` not before one letter), and the names of other commands. Groups do not nest; lone braces go."""
    group = r"\{[^}]*\}"
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\$([^$]+)\$", "$1")
    out = _mapped(out, r"\\[a-zA-Z]+|[^\\]+|\\", _symbol)
    out = _mapped(out, rf"\\frac{group}{group}|\\(?:sqrt|text|mathrm|mathbf){group}|[^\\]+|\\", _grouped)

    def marked(part: Column) -> Column:
        inner = F.translate(F.substring(part, F.lit(2), F.length(part)), "{}", "")
        put = lambda ends: F.concat(F.lit(ends[0]), inner, F.lit(ends[1]))
        raised, lowered, wide = part.startswith("^"), part.startswith("_"), F.length(part) > (1 if single else 2)
        return F.when(raised & wide, put(up)).when(lowered & wide, put(down)).when(part.rlike(r"^\\[a-zA-Z]"), F.substring(part, F.lit(2), F.length(part))).when(part.isin("{", "}"), "").otherwise(part)

    one = "[a-zA-Z0-9]"
    for _ in range(2):
        out = _mapped(out, rf"[\^_]{group}|[\^_]{one}|\\[a-zA-Z]+|[{{}}]|[^\\^_{{}}]+|[\s\S]", marked)
    return out


def formula_markup(text: Column) -> Column:
    """Formulas with <super> and <sub>; other angle brackets and ampersands are escaped."""
    out = F.replace(_formula(text, ("<super>", "</super>"), ("<sub>", "</sub>"), True), F.lit("&"), F.lit("&amp;"))
    out = F.regexp_replace(out, r"<(/?(?:super|sub|b|i))>", "\u0001$1\u0002")
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.translate(out, "\u0001\u0002", "<>")


def formula_plain(text: Column) -> Column:
    return F.trim(_formula(text, ("^", ""), ("_", ""), False))


def comparison_text(text: Column) -> Column:
    """Lower case without formulas, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\$[^$]*\$", ""), r"(?U)\s+", " "))


def short_key(question: Column) -> Column:
    return F.substring(F.md5(F.lower(question)), 1, 12)


def long_key(question: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(question)), 256), 1, 16)


def retryable(message: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.upper(message).contains(k.upper()) for k in RETRYABLE])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


#: A string, read without going back; braces, and what stands between them, strings and all.
JSON_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
JSON_PARTS = rf'[{{}}]|(?:[^"{{}}]++|{JSON_STRING})++|"'


def json_objects(text: Column) -> Column:
    """The outermost objects of a text from its first brace on: from each brace to the one that closes it, outside strings."""

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "{", 1).when((part == "}") & (s["depth"] > 0), -1).otherwise(0)
        opens, closes = (part == "{") & (s["depth"] == 0), (part == "}") & (s["depth"] == 1)
        spans = F.when(closes, F.concat(s["spans"], F.array(F.struct(s["first"].alias("at"), (s["i"] - s["first"] + 1).alias("n"))))).otherwise(s["spans"])
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), F.when(opens, s["i"]).otherwise(s["first"]).alias("first"), spans.alias("spans"))

    start = F.struct(F.lit(1).alias("i"), F.lit(0).alias("depth"), F.lit(1).alias("first"), F.array().cast("array<struct<at:int,n:int>>").alias("spans"))
    cut = lambda parts: F.transform(F.aggregate(parts, start, step, lambda s: s["spans"]), lambda x: F.array_join(F.slice(parts, x["at"], x["n"]), ""))
    return let(F.regexp_extract_all(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(JSON_PARTS), F.lit(0)), cut)


def mended_json(text: Column) -> Column:
    """Between strings, a comma before a closing bracket goes; in strings, a backslash that begins no escape is doubled."""
    parts = F.regexp_extract_all(text, F.lit(rf'{JSON_STRING}|[^"]++|"'), F.lit(0))
    told = F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), _doubled(p)).otherwise(F.regexp_replace(p, r",(\s*[\]}])", "$1"))), "")
    return F.when(text.contains("\\"), told).otherwise(F.regexp_replace(text, rf"({JSON_STRING})|,(\s*[\]}}])", "$1$2"))  # strings stay as they are without backslashes


def repaired_json(raw: Column) -> Column:
    """The first object in an answer that is JSON, as it is or mended; null if there is none.

    What stands in the first fence is read before the whole answer, and of each its outermost objects one after the
    other, then all from its first brace to its last. What comes before and after an object is left out.
    """
    fence = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = lambda text: F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda o: F.when(o.startswith("{") & F.try_parse_json(o).isNotNull(), o)
    read = lambda o: F.coalesce(valid(o), let(mended_json(o), valid))  # mended only if it must be
    first = lambda objects: F.get(F.filter(F.transform(objects, lambda o: read(o)), lambda o: o.isNotNull()), F.lit(0))
    return F.coalesce(*[way for text in (fence, raw) for way in (first(json_objects(text)), let(braces(text), read))])


def _doubled(string: Column) -> Column:
    """Backslashes that begin no escape are doubled; one that follows another backslash does not begin any."""
    return F.regexp_replace(string, r'(?<!\\)((?:\\\\)*)\\(?![\\"/bfnrtu])', r"$1\\\\")


def iso_time(at: Column) -> Column:
    """A timestamp as text in ISO form, with fractions of a second only where there are any."""
    fraction = F.when(F.date_format(at, "SSSSSS") == "000000", F.lit("")).otherwise(F.date_format(at, ".SSSSSS"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def printed_date(at: Column) -> Column:
    """Day, month and year as a paper shows them: 31/12/2024."""
    return F.date_format(at, "dd/MM/yyyy")


def uptime(since: Column, now: Column) -> Column:
    """The time between two timestamps as "2 days, 3:04:05", without the days if there are none."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(since)
    days = F.expr("0L") + F.floor(seconds / 86_400)
    rest = seconds - days * 86_400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.concat(days.cast("string"), F.lit(" days, "))), clock)


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a data URI, or of bare base64; null if it is neither."""
    return F.try_to_binary(F.when(uri.contains(","), F.regexp_extract(uri, r"(?s)^[^,]*,(.*)$", 1)).otherwise(uri), F.lit("base64"))
