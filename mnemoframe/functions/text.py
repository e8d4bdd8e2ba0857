"""Text functions as Column expressions; Python only where SQL can't say it (HTML, NFKD, snippets)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Function words that the index leaves out, German then English.
STOPWORDS = tuple(
    """
    aber alle alles als also am an auch auf aus bei bin bis bist da dann das dass dem den der des die dies diese dieser
    doch dort du durch ein eine einem einen einer eines er es etwas euch for fuer für hab habe haben hast hat hatte hatten
    ich ihr im in ist ja jetzt kann kannst mal man mich mir mit muss nach nicht noch nun nur ob oder schon sein sich sie
    sind so soll um und uns unter vom von vor war waren was weil wenn wer wie wieder wir wird wo zu zum zur
    a an and are as at be but by can do for from has have how i if in into is it its me my of on or so that the then there
    this to was we were what when which with you your
    """.split()
)
WORD = r"[\p{L}\p{N}]+"
#: Half-lives in days: search results, and candidates for distilling.
SEARCH_HALF_LIFE, DISTILL_HALF_LIFE = 120.0, 365.0
TITLE_REPEAT = 2


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes off spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def raw_words(c: Column) -> Column:
    """Lower-case words of letters and digits; repeats stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), 0)


def is_term(word: Column) -> Column:
    """Longer than one character and no function word."""
    return (F.length(word) > 1) & ~word.isin(*STOPWORDS)


def tokenize(c: Column) -> Column:
    """The words of a text that are terms, in order."""
    return F.filter(raw_words(c), is_term)


def doc_tokens(title: Column, body: Column) -> Column:
    """Tokens of an indexed document: the title's count double."""
    head = tokenize(title)
    return F.concat(*[head] * TITLE_REPEAT, tokenize(body))


def recency(day: Column, today: Column, half_life: float = SEARCH_HALF_LIFE) -> Column:
    """0.5 ** (age / half-life); a day to come has age 0, and no day at all counts 0.5."""
    age = F.greatest(F.datediff(today, day), F.lit(0))
    return F.when(day.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age / F.lit(half_life)))


def contains_folded(haystack: Column, needle: Column | str) -> Column:
    """Substring test that ignores case by lower-casing both; nothing in the needle is special."""
    n = F.lit(needle.lower()) if isinstance(needle, str) else F.lower(needle)
    return F.contains(F.lower(haystack), n)


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """(terms, those that were quoted). Quotes hold words together; a lone quote is taken off."""
    terms, quoted = [], []
    for phrase, bare in re.findall(r'"([^"]+)"|(\S+)', query):
        term = phrase or bare.strip('"')
        if term:
            terms.append(term)
        if phrase:
            quoted.append(phrase)
    return terms, quoted


def join_query(args: Sequence[str]) -> str:
    """Command-line arguments as one query: an argument with a space was quoted."""
    return " ".join(f'"{a}"' if " " in a and '"' not in a else a for a in args)


def alternation(terms: Sequence[str]) -> str:
    """One Java pattern for all terms, literal, longest first, ignoring case."""
    quote = lambda t: "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return "(?iu)" + "|".join(quote(t) for t in sorted(terms, key=len, reverse=True))


def count_matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def snippets(c: Column, terms: Sequence[str], before: int = 60, after: int = 90) -> Column:
    """The surroundings of the first hit of any term in each text, cut at spaces; empty without one."""
    pattern = alternation(terms)
    # What stands before the hit tells its place in characters; places that patterns give are in UTF-16.
    hit = F.struct(c.alias("t"), F.length(F.split(c, pattern, 2)[0]).alias("a"), F.length(F.regexp_substr(c, F.lit(pattern))).alias("n"))

    def cut(h: Column) -> Column:
        whole, low = F.length(h["t"]), F.greatest(h["a"] - before, F.lit(0))
        back = F.locate(" ", F.reverse(F.substring(h["t"], F.lit(1), low)))  # from the cut to the last space before it
        left = F.when(back == 0, F.lit(0)).otherwise(low - back + 1)
        high = F.least(h["a"] + h["n"] + after, whole)
        space = F.call_function("locate", F.lit(" "), h["t"], high + 1)
        right = F.when((high < whole) & (space > 0), space - 1).otherwise(whole)
        return F.when(h["n"].isNotNull(), collapse(F.substring(h["t"], left + 1, right - left)))

    return F.coalesce(let(hit, cut), F.lit(""))


#: Western European letters with accents, and without.
LATIN = ("áàâãåéèêëíìîïóòôõúùûñçýÿÁÀÂÃÅÉÈÊËÍÌÎÏÓÒÔÕÚÙÛÑÇÝ", "aaaaaeeeeiiiioooouuuncyyAAAAAEEEEIIIIOOOOUUUNCY")
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))


def slug_of(value: str | None, longest: int = 48) -> str:
    for a, b in UMLAUTS:
        value = (value or "").replace(a, b)
    plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:longest].rstrip("-") or "untitled"


def slugify(c: Column, longest: int = 48) -> Column:
    """ASCII words joined by hyphens. Accents beyond the Western European ones go by NFKD, which has no SQL form; only texts that have such letters are sent to Python."""
    plain = "".join(a for a, _ in UMLAUTS) + LATIN[0]
    other = F.when(c.rlike(f"[^\\x00-\\x7F{plain}]"), c)
    return F.coalesce(_each(other, "string", lambda v: None if v is None else slug_of(v, longest)), slugify_latin(F.coalesce(c, F.lit("")), longest))


def slugify_latin(c: Column, longest: int = 48) -> Column:
    """As ``slugify`` for the accents of Western European languages, without Python."""
    for a, b in UMLAUTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    plain = F.lower(F.translate(c, *LATIN))
    ascii_only = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    cut = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest), "-+$", "")
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


def short_id(conv_id: Column, length: int = 8) -> Column:
    return F.substring(F.sha1(conv_id), 1, length)


def doc_path(source: Column, day: Column, title: Column, project: Column, conv_id: Column, slug: Callable[[Column], Column] = slugify) -> Column:
    """source/year/day--source--slug--id.md; a document without a day has 0000-00-00. The slug is that of the title, or of the project where there is none."""
    d = F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("0000-00-00"))
    name = slug(F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(project))
    return F.concat(source, F.lit("/"), F.substring(d, 1, 4), F.lit("/"), F.concat_ws("--", d, source, name, short_id(conv_id)), F.lit(".md"))


def doc_signature(doc_id: Column) -> Column:
    """What of a doc_id stays when its day moves: source, slug and short id; null if it hasn't four parts."""
    stem = F.regexp_replace(F.element_at(F.split(doc_id, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "--")
    n = F.size(parts)
    whole = F.concat_ws("\u0001", parts[1], F.array_join(F.slice(parts, 3, F.greatest(n - 3, F.lit(0))), "--"), F.try_element_at(parts, F.lit(-1)))
    return F.when(n >= 4, whole)


def content_key(title: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", title, body), 256), 1, 20)


def source_fingerprint(turns: Column) -> Column:
    """Revision of a document's user turns (machine_summary, text); no time stamps, so a moved date changes nothing."""
    rows = F.transform(F.filter(turns, lambda t: t["role"] == "user"), lambda t: F.struct(t["machine_summary"].alias("machine_summary"), t["text"].alias("text")))
    return F.substring(F.sha2(F.to_json(rows), 256), 1, 16)


# ---------------------------------------------------------------- harness noise

#: Blocks that a harness puts into user turns.
NOISE_TAGS = "system-reminder|command-message|command-args|local-command-stdout|local-command-stderr|task-notification"


def strip_noise(c: Column) -> Column:
    """Without harness blocks; of a command's block the name stays."""
    clean = F.regexp_replace(c, rf"(?is)<({NOISE_TAGS})>.*?</\1>", "")
    return strip(F.regexp_replace(clean, r"(?is)<command-name>\s*(.*?)\s*</command-name>", "$1"))


def machine_authored(c: Column) -> Column:
    """A user turn that isn't the person's own words: a summary by the harness, or a pasted dialogue."""
    summary = c.rlike(r"(?i)^\s*(this session is being continued from a previous conversation|<summary>|\[external unsupported block)")
    pasted = F.regexp_count(c, F.lit(r"(?im)^\s*(ChatGPT|Du|Assistant|Gemini|Claude|User|Nutzer)\s*:\s*$")) >= 2
    return F.coalesce(summary | pasted, F.lit(False))


# ---------------------------------------------------------------- prose

#: How a line begins that a machine wrote.
MACHINE_LINE = "|".join((
    r"[{\[\"]",
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}",
    r"File \"|Traceback| +at |\.\.\.",
    r"Collecting|Downloading|Requirement|Installing|Successfully|Using cached",
    r"[a-zA-Z0-9_./-]+\.(?:py|ts|tsx|js|json|lock):\d+",
    r"[$#>%](?:[\t ]|$)|\(\.?venv\)",
    r"(?:PS\s+(?:[a-zA-Z]:\\|/)[^>\r\n]*>|[\w.-]+@[\w.-]+:(?:/|~|\.)[^$#%\r\n]*[$#%]|[\w.-]+@[\w-]+\s+(?:~|/[^%\r\n]*|[\w./-]+)\s+%)(?:[\t ]|$)",
    r"(?:npm|pip|yarn|pnpm|git|cd|ls|sudo) ",
    r"<(?:!DOCTYPE|/?[a-zA-Z][a-zA-Z0-9-]*(?:\s|>|/))",
    r"\d+/\d+\s+\[[=\-> ]*\]\s+\d+%",
    r"[-=]{3,}(?:\s+[-=]{3,})+\s*$",
    r"Windows\s+PowerShell\s*$",
    r"Copyright\s+\(C\)\s+Microsoft\s+Corporation\.(?:\s+(?:All\s+rights\s+reserved\.|Alle\s+Rechte\s+vorbehalten\.))?\s*$",
    r"Last\s+login:",
    r"Generating\s+Thumbnails\s+for\s+\d+\s+files\.",
    r"(?:Generated|Skipped|Errors)\s+\d+\s*$",
))
#: What marks a line of source code.
CODE_LINE = (
    r"^\s*//|^\s*#(?!\s)|^\s*(?:def|class|function|const|let|var|import|from|return|if|for)\b"
    r"|\w+\s*=\s*\w+\(|=>|\{\s*$|^\s*\}|;\s*$|\binput\.(?:bool|int|float|string|color)\("
)
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns (replacing those of their names) that are computed once a row: the optimizer would copy them to each place that names them, filters as well."""
    made = F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made)


def machine_line(line: Column) -> Column:
    """Begins like a log, a dump or a shell, or is long, ends in no sentence and is full of symbols."""
    bare = strip(line)
    symbols = F.length(F.regexp_replace(bare, r"[\p{L}\p{N}\s]", ""))
    noisy = (F.length(line) > 200) & (F.length(bare) > 200) & ~bare.rlike(r"[.!?:]\s*$") & (symbols / F.length(bare) > 0.12)
    return line.rlike(r"(?U)\S") & (line.rlike(rf"(?U)^\s*(?:{MACHINE_LINE})") | noisy)


def _full_lines(block: Column) -> Column:
    return F.filter(F.split(block, LINE_END), lambda x: x.rlike(r"(?U)\S"))


def _like_code(lines: Column) -> Column:
    return (F.size(lines) >= 8) & (F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))) >= 0.25 * F.size(lines))


def code_block(block: Column) -> Column:
    """At least eight lines, and a quarter of them look like source code."""
    return let(_full_lines(block), _like_code)


def prose_ratio(c: Column) -> Column:
    """Share of characters in lines that read like speech; blocks of code count nothing."""
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    own = lambda lines: F.when(_like_code(lines), F.lit(0)).otherwise(size(F.filter(lines, lambda x: ~machine_line(x))))
    share = lambda blocks: F.when(size(blocks) > 0, F.aggregate(blocks, F.lit(0), lambda n, b: n + let(_full_lines(b), own)) / size(blocks)).otherwise(F.lit(0.0))
    return let(F.filter(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda b: b.rlike(r"(?U)\S")), share)


# ---------------------------------------------------------------- HTML and Markdown

BLOCK_TAGS = frozenset("p div br li h1 h2 h3 h4 h5 h6 tr hr".split())


class _PlainText(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data: str) -> None:
        self.out.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.out.append("\n" * (tag in BLOCK_TAGS))

    def handle_endtag(self, tag: str) -> None:
        self.out.append("\n" * (tag in BLOCK_TAGS))


def plain_text(html: str | None) -> str:
    parser = _PlainText()
    parser.feed(unescape(html or ""))
    parser.close()
    return "\n".join(s for line in "".join(parser.out).splitlines() if (s := line.strip()))


def _each(c: Column | str, kind: str, f: Callable) -> Column:
    """A pandas UDF of f over one column; made when it is used, as workers import this module without a session."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f(v) for v in values], dtype=object)

    return F.pandas_udf(run, kind)(c)


def html_to_text(html: Column | str) -> Column:
    """Text of an HTML fragment: entities resolved first, block tags as line ends, blank lines gone; script text stays."""
    return _each(html, "string", plain_text)


def visible_lines(markdown: str | None) -> list[str]:
    """Body lines outside front matter, fences and inline code."""
    lines = (markdown or "").splitlines()
    if lines[:1] == ["---"] and "---" in lines[1:]:
        lines = lines[lines.index("---", 1) + 1 :]
    out, fence = [], None
    for line in lines:
        mark = line.lstrip()[:3]
        if fence is None and mark in ("```", "~~~"):
            fence = mark
        elif fence is not None:
            fence = None if mark == fence else fence
        else:
            out.append(re.sub(r"(`+).*?\1", "", line))
    return out


LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")


def wikilinks(markdown: Column | str) -> Column:
    """Targets of [[...]] in the visible text, in order."""
    return _each(markdown, "array<string>", lambda m: LINK.findall("\n".join(visible_lines(m))))


def _left_over(markdown: str | None) -> list[int]:
    bare = (LINK.sub("", x) for x in visible_lines(markdown))
    return [i for i, x in enumerate(bare, 1) if "[[" in x or "]]" in x]


def malformed_links(markdown: Column | str) -> Column:
    """Numbers of visible lines with [[ or ]] left over once whole links are taken out."""
    return _each(markdown, "array<int>", _left_over)


def normalize_reference(c: Column) -> Column:
    """A link or path as a node id: without quotes, brackets, alias, heading and .md; null if it is empty or climbs."""
    ref = F.trim(F.regexp_replace(F.trim(c), r"""^(["'])(.*)\1$""", "$2"))
    ref = F.regexp_replace(ref, r"^\[\[([^\[\]\n]+)\]\]$", "$1")
    ref = F.trim(F.split(F.split(ref, r"\|")[0], "#")[0])
    ref = F.regexp_replace(F.regexp_replace(F.regexp_replace(ref, r"\.md$", ""), r"\\", "/"), "^/+|/+$", "")
    climbs = F.exists(F.split(ref, "/"), lambda p: p.isin("", ".", ".."))
    return F.when((ref != "") & ~climbs, ref)


def front_value(c: Column, key: str) -> Column:
    """A field of the YAML front matter, unquoted; empty if absent."""
    front = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n", 1)
    return F.regexp_replace(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*['\"]?(.*?)['\"]?[ \t]*$", 1), "''", "'")


def body_of(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")


def safe_path(c: Column) -> Column:
    """Relative and without climbing."""
    return ~F.startswith(c, F.lit("/")) & ~F.array_contains(F.split(c, "/"), "..")


def chunks(head: Column, turns: Column, whole: Column, longest: int = 1500, least: int = 40) -> Column:
    """Chunks for embedding: each turn in windows of ``longest`` characters behind the header, short rests left out; a text without any is one chunk, cut."""
    cut = lambda body: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(body) - 1) / longest), F.lit(0)).cast("int")), lambda i: F.substring(body, i * longest + 1, F.lit(longest)))
    pieces = F.filter(F.flatten(F.transform(turns, lambda t: cut(collapse(t["text"])))), lambda p: F.length(p) > least)
    found = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.substring(collapse(whole), 1, longest)))
    return F.transform(found, lambda p: F.concat(head, p))


def grade(answer: Column, must: Column, reject: Column) -> Column:
    """No rejected phrase in the answer, and one alternative of each group that it must have."""
    low = F.lower(answer)
    bad = F.exists(F.coalesce(reject, F.array().cast("array<string>")), lambda r: F.contains(low, F.lower(r)))
    return ~bad & F.forall(must, lambda g: F.exists(g, lambda a: F.contains(low, F.lower(a))))
