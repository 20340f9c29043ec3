"""Rule-table romanization as one JVM column expression.

The original tooling pipes text through an external rule program per chunk.
Here the rules are a small table ``(lang, src, roman)``: ``lang`` None
applies to every row, a language code only to rows of that language (its
rules run first, so they override). The expression built from the table is

1. multi-character sources (digraphs), longest first, by ``replace``;
2. single characters with a non 1:1 output by ``replace``;
3. all 1:1 characters in one ``translate``;
4. Hangul syllables by code-point arithmetic (only on rows holding one);
5. Python ``str.strip()`` of the result.

The rule table is parameter-sized (hundreds of rows), so it is read on the
driver to build the expression; the corpus itself never leaves the
executors. Han characters and anything else without a rule pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import PY_STRIP_RE, let, py_strip

# Romanization rules (lang, source, roman).
LATIN_RULES = [
    ("á", "a"), ("à", "a"), ("â", "a"), ("ä", "a"), ("ã", "a"), ("å", "a"), ("ā", "a"),
    ("ç", "c"), ("é", "e"), ("è", "e"), ("ê", "e"), ("ë", "e"), ("ē", "e"),
    ("í", "i"), ("ì", "i"), ("î", "i"), ("ï", "i"), ("ñ", "n"),
    ("ó", "o"), ("ò", "o"), ("ô", "o"), ("ö", "o"), ("õ", "o"), ("ø", "o"),
    ("ú", "u"), ("ù", "u"), ("û", "u"), ("ü", "u"), ("ý", "y"), ("ÿ", "y"),
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"),
]
GERMAN_RULES = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")]
GREEK_RULES = [
    ("ου", "ou"),
    ("α", "a"), ("β", "v"), ("γ", "g"), ("δ", "d"), ("ε", "e"), ("ζ", "z"), ("η", "i"),
    ("θ", "th"), ("ι", "i"), ("κ", "k"), ("λ", "l"), ("μ", "m"), ("ν", "n"), ("ξ", "x"),
    ("ο", "o"), ("π", "p"), ("ρ", "r"), ("σ", "s"), ("ς", "s"), ("τ", "t"), ("υ", "y"),
    ("φ", "f"), ("χ", "ch"), ("ψ", "ps"), ("ω", "o"),
    ("ά", "a"), ("έ", "e"), ("ή", "i"), ("ί", "i"), ("ό", "o"), ("ύ", "y"), ("ώ", "o"),
]
CYRILLIC_RULES = [
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ё", "yo"),
    ("ж", "zh"), ("з", "z"), ("и", "i"), ("й", "y"), ("к", "k"), ("л", "l"), ("м", "m"),
    ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"),
    ("ф", "f"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"),
    ("ъ", ""), ("ы", "y"), ("ь", ""), ("э", "e"), ("ю", "yu"), ("я", "ya"),
]
KANA_RULES = [
    ("あ", "a"), ("い", "i"), ("う", "u"), ("え", "e"), ("お", "o"),
    ("か", "ka"), ("き", "ki"), ("く", "ku"), ("け", "ke"), ("こ", "ko"),
    ("さ", "sa"), ("し", "shi"), ("す", "su"), ("せ", "se"), ("そ", "so"),
    ("た", "ta"), ("ち", "chi"), ("つ", "tsu"), ("て", "te"), ("と", "to"),
    ("な", "na"), ("に", "ni"), ("ぬ", "nu"), ("ね", "ne"), ("の", "no"),
    ("は", "ha"), ("ひ", "hi"), ("ふ", "fu"), ("へ", "he"), ("ほ", "ho"),
    ("ま", "ma"), ("み", "mi"), ("む", "mu"), ("め", "me"), ("も", "mo"),
    ("や", "ya"), ("ゆ", "yu"), ("よ", "yo"),
    ("ら", "ra"), ("り", "ri"), ("る", "ru"), ("れ", "re"), ("ろ", "ro"),
    ("わ", "wa"), ("を", "wo"), ("ん", "n"),
]
# Revised Romanization jamo values, in code-point order.
HANGUL_INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj",
                   "ch", "k", "t", "p", "h"]
HANGUL_MEDIALS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo",
                  "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
HANGUL_FINALS = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l",
                 "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3


def _with_capitals(pairs):
    """Add the capital form of every rule whose source has one (rule: upper
    source → capitalised roman)."""
    out = list(pairs)
    for s, r in pairs:
        u = s.upper()
        if u != s and len(u) == len(s):
            out.append((u, r[:1].upper() + r[1:]))
    return out


def default_rules() -> list[tuple[str | None, str, str]]:
    rules: list[tuple[str | None, str, str]] = []
    for group in (LATIN_RULES, GREEK_RULES, CYRILLIC_RULES):
        rules += [(None, s, r) for s, r in _with_capitals(group)]
    rules += [(None, s, r) for s, r in KANA_RULES]
    rules += [("de", s, r) for s, r in GERMAN_RULES]
    # de-duplicate on (lang, src), first wins
    seen, out = set(), []
    for lang, s, r in rules:
        if (lang, s) not in seen:
            seen.add((lang, s))
            out.append((lang, s, r))
    return out


def rules_from_table(df: DataFrame, limit: int = 100_000) -> list[tuple[str | None, str, str]]:
    """Read a user rule table ``(lang, src, roman)``; refuses tables beyond
    ``limit`` rows (a rule set, not a corpus)."""
    n = df.count()
    if n > limit:
        raise ValueError(f"rule table has {n} rows, more than {limit}")
    return [(r["lang"], r["src"], r["roman"]) for r in df.select("lang", "src", "roman").collect()]


def _plan(rules):
    multi = sorted([(s, r) for s, r in rules if len(s) > 1], key=lambda t: -len(t[0]))
    one_n = [(s, r) for s, r in rules if len(s) == 1 and len(r) != 1]
    one_one = [(s, r) for s, r in rules if len(s) == 1 and len(r) == 1]
    return multi, one_n, one_one


def _script(ch: str) -> int:
    """Group rules by 256-code-point block (Latin-1, Greek, Cyrillic, kana…)."""
    return ord(ch[0]) >> 8


def _char_class(chars) -> str:
    """One code-point range covering the characters: a range test is a
    single comparison, where a long list of single characters costs the
    regex engine one test per listed character at every text position."""
    cps = [ord(c) for c in chars]
    return "[\\x{%x}-\\x{%x}]" % (min(cps), max(cps))


def _group_step(rs, guard):
    def step(x):
        chain = x
        for s, r in rs:
            chain = F.replace(chain, F.lit(s), F.lit(r))
        return F.when(x.rlike(guard), chain).otherwise(x)
    return step


def _apply(col: Column, rules) -> Column:
    """Replace chains grouped by script, each behind one ``rlike`` guard (a
    row without any source character of the group skips the group), then
    one ``translate`` for every 1:1 rule."""
    multi, one_n, one_one = _plan(rules)
    c = col
    groups: dict[int, list] = {}
    for s, r in multi + one_n:
        groups.setdefault(_script(s), []).append((s, r))
    for _, rs in sorted(groups.items()):
        c = let(c, _group_step(rs, _char_class(s[0] for s, _ in rs)))
    if one_one:
        c = F.translate(c, "".join(s for s, _ in one_one), "".join(r for _, r in one_one))
    return c


def _hangul(col: Column) -> Column:
    ini = F.array(*[F.lit(x) for x in HANGUL_INITIALS])
    med = F.array(*[F.lit(x) for x in HANGUL_MEDIALS])
    fin = F.array(*[F.lit(x) for x in HANGUL_FINALS])

    def one(ch):
        cp = F.ascii(ch)
        s = cp - F.lit(HANGUL_FIRST)
        return F.when((cp >= HANGUL_FIRST) & (cp <= HANGUL_LAST),
                      F.concat(F.element_at(ini, (F.floor(s / 588) + 1).cast("int")),
                               F.element_at(med, (F.floor(F.pmod(s, F.lit(588)) / 28) + 1).cast("int")),
                               F.element_at(fin, (F.pmod(s, F.lit(28)) + 1).cast("int")))).otherwise(ch)
    return let(col, lambda x: F.when(x.rlike("[가-힣]"),
                                     F.array_join(F.transform(F.split(x, ""), one), "")).otherwise(x))


def romanize(col, lang: Column | str | None = None, rules=None, strip: bool = True) -> Column:
    """Romanize a text column. ``lang`` (a column or a literal code) selects
    language-specific rules, applied before the general ones."""
    c = F.col(col) if isinstance(col, str) and not isinstance(col, Column) else col
    rules = rules if rules is not None else default_rules()
    general = [(s, r) for lg, s, r in rules if lg is None]
    langs = sorted({lg for lg, _, _ in rules if lg is not None})
    if lang is not None and langs:
        lc = lang if isinstance(lang, Column) else F.lit(lang)
        pre = c
        for lg in langs:
            specific = [(s, r) for l2, s, r in rules if l2 == lg]
            pre = F.when(lc == F.lit(lg), _apply(c, specific)).otherwise(pre)
        c = pre
    out = _hangul(_apply(c, general))
    return py_strip(out) if strip else out


def sql_romanize(expr: str, lang_expr: str | None = None, rules=None, strip: bool = True) -> str:
    """DuckDB twin for the rule steps 1-3 and 5 (Hangul arithmetic is covered
    by unit tests; the driver corpus holds none)."""
    rules = rules if rules is not None else default_rules()

    def q(s):
        return "'" + s.replace("'", "''") + "'"

    def apply(e, rs):
        multi, one_n, one_one = _plan(rs)
        for s, r in multi + one_n:
            e = f"replace({e}, {q(s)}, {q(r)})"
        if one_one:
            e = f"translate({e}, {q(''.join(s for s, _ in one_one))}, {q(''.join(r for _, r in one_one))})"
        return e
    general = [(s, r) for lg, s, r in rules if lg is None]
    out = apply(expr, general)
    langs = sorted({lg for lg, _, _ in rules if lg is not None})
    if lang_expr is not None and langs:
        branches = " ".join(
            f"WHEN {lang_expr} = {q(lg)} THEN {apply(apply(expr, [(s, r) for l2, s, r in rules if l2 == lg]), general)}"
            for lg in langs)
        out = f"(CASE {branches} ELSE {out} END)"
    return f"regexp_replace({out}, '{PY_STRIP_RE}', '', 'g')" if strip else out
