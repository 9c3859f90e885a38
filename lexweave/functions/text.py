"""Cleaning steps on one text, as column expressions. All give null for null."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import patterns as P

# Characters that count as one symbol.
QUOTES = "«»‹›„‚“‟‘‛”’"
DASHES = "\u2012\u2013\u2014\u2015\u203E\u0305\u00AF"
HYPHENS = "\u2010\u2011"
SPACES = "\u2000\u2001\u2002\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u200B\u202F\u205F\u2060\u3000"
BULLETS = "\u02CC\u0307\u0323\u2022\u2023\u2043\u204C\u204D\u2219\u25E6\u00B7\u00D7\u22C5\u2062"
TILDES = "\u2241\u224B\u2E2F\u0483"
LATIN, PLAIN = "ÄäËë\u1E26\u1E27ÏïÖöÜüŸÿßẞ", "AaEeHhIiOoUuYysS"
EM_SPACE, EN_SPACE, HARD_SPACE = "\u2003", "\u2002", "\u00A0"
# End of fixed values.


def _replace(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, *p), pairs, text)


def unify_symbols(text: Column) -> Column:
    """Quotes, dashes, hyphens, spaces, bullets and ellipses to one sign each; some Latin letters lose their marks.
    A dash becomes a hyphen between em spaces, two hyphens one."""
    text = F.translate(text, QUOTES, '"' * len(QUOTES))
    text = _replace(text, (f"[{DASHES}]", f"{EM_SPACE}--{EM_SPACE}"), (f"[{HYPHENS}]", "-"), ("--", "-"))
    text = F.translate(text, SPACES + HARD_SPACE, EN_SPACE * len(SPACES) + " ")
    text = _replace(text, (EM_SPACE * 2, EM_SPACE), ("\t\t", "\t"))
    text = F.translate(text, BULLETS + "∗" + TILDES, "." * len(BULLETS) + "*" + "∽" * len(TILDES))
    return F.translate(_replace(text, ("…", "...")), LATIN, PLAIN)


def replace_each(text: Column, search: str, replacement: str) -> Column:
    """Each character of search by replacement (any text)."""
    return F.regexp_replace(text, f"[{P.in_class(search)}]", replacement)


def slug(text: Column, most: int = 200) -> Column:
    """A file-safe name of at most most characters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", ""), r"(?U)[-\s]+", "-")
    return F.substring(F.regexp_replace(plain, "^[-_]+|[-_]+$", ""), 1, most)


def mask_digits(word: Column) -> Column:
    return F.repeat(F.lit("x"), F.length(word))


def clean_token(token: Column, misc: Column) -> Column:
    """The token without spaces; null for the word for file, where the tagger joined it to the next."""
    return F.when((token == "Файл") & misc.contains("SpaceAfter=No"), None).otherwise(F.replace(F.trim(token), F.lit(" "), F.lit("")))


def clean_lemma(lemma: Column, pos: Column) -> Column:
    """The lemma in lower case without spaces, underscores, a guillemet on either side and a final mark; null for a
    bar or a picture's name. Punctuation keeps its marks."""
    plain = F.lower(F.translate(F.trim(lemma), " _", ""))
    bare = _replace(plain, ("^[«»]", ""), ("[«»]$", ""), ("[!?,.]$", ""))
    # Most lemmas have none of the characters that matter, and need no further pattern.
    return F.when(~plain.rlike("[«»!?,.|]"), plain).when(plain.rlike(r"\||\.jpg$|\.png$"), None).when(pos == "PUNCT", plain).otherwise(bare)


def mask_quotes(text: Column) -> Column:
    return F.regexp_replace(text, P.QUOTED, "QUOTE")


def mask_styles(text: Column, tag: str | None = None) -> Column:
    """Bold and italic spans, or those of one tag, to STYLE."""
    return F.regexp_replace(text, P.STYLED if tag is None else rf"(?s)<{tag}>.*?</{tag}>", "STYLE")


def terminal_periods(text: Column) -> Column:
    """Exclamation and question marks, and a colon at the end of the text, to periods."""
    return F.regexp_replace(text, P.SENTENCE_END, ".")


def join_lines(text: Column, compat: bool = False) -> Column:
    """Without hyphens at line ends (compat: nor the letter before), other line ends being spaces."""
    text = F.regexp_replace(text, P.LINE_END_HYPHEN_COMPAT, "") if compat else F.regexp_replace(text, P.LINE_END_HYPHEN, "$1")
    return F.replace(text, F.lit("\n"), F.lit(" "))


#: Pieces of a text that are joined at a time: what a fold appends to stays short.
_JOINED = 32


def strip_brackets(text: Column) -> Column:
    """Without what stands in parentheses or brackets, however nested; an opener without its closer takes the rest of
    the text, a closer without an opener stays. Pairs with no mark between them go by a pattern, three times over; what
    then has openers left is folded over its marks and the runs between them. Kept runs are gathered in a short
    array, which is joined when it is full, since appending copies."""
    for _ in range(3):
        text = F.regexp_replace(text, r"\([^\[\]()]*\)|\[[^\[\]()]*\]", "")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("square"), F.lit(0).alias("round"), none.alias("part"), none.alias("done"))

    def step(at: Column, c: Column) -> Column:
        outside = (at["square"] == 0) & (at["round"] == 0)
        closes_square, closes_round = (c == "]") & (at["square"] > 0), (c == ")") & (at["round"] > 0)
        kept, full = outside & ~(c.isin("[", "(") | closes_square | closes_round), F.size(at["part"]) >= _JOINED
        return F.struct(
            F.when(c == "[", at["square"] + 1).when(closes_square, at["square"] - 1).otherwise(at["square"]).alias("square"),
            F.when(c == "(", at["round"] + 1).when(closes_round, at["round"] - 1).otherwise(at["round"]).alias("round"),
            F.when(kept & full, F.array(c)).when(kept, F.array_append(at["part"], c)).otherwise(at["part"]).alias("part"),
            F.when(kept & full, F.array_append(at["done"], F.array_join(at["part"], ""))).otherwise(at["done"]).alias("done"),
        )

    def folded(text: Column) -> Column:
        # Runs without a mark are one step each, so the fold has as many steps as the text has marks, twice.
        head, rest = F.regexp_extract(text, r"^[^\[(]*", 0), F.regexp_extract(text, r"(?s)[\[(].*$", 0)
        runs = F.regexp_extract_all(rest, F.lit(r"[\[\]()]|[^\[\]()]+"), F.lit(0))
        return F.when(text.rlike(r"[\[(]"), F.aggregate(runs, start, step, lambda at: F.array_join(F.concat(F.array(head), at["done"], at["part"]), ""))).otherwise(text)

    # As the one element of an array the text has a name, and is not made again for each use.
    return F.get(F.transform(F.array(text), folded), F.lit(0))


def strip_footnote_references(text: Column, strict: bool = True) -> Column:
    """Numbers before a period or comma with it, and numbers glued to a word: with the word and the space after
    (strict) or without."""
    if strict:
        return F.regexp_replace(text, P.FOOTNOTE_REFERENCE_WORD, "")
    return _replace(text, (r"(?U)(?<=\D|^)\d+(?=[.,])", ""), (r"(?U)(?<=[^\s\d])\d+(?=\s)", ""))


def mask_unknown(text: Column, alphabet: str = "cyrillic") -> Column:
    return F.regexp_replace(text, P.out_of_vocabulary(alphabet), "UNK")


def mask_numbers(text: Column) -> Column:
    return _replace(text, (P.ARABIC_NUMBER, "NUM_arab"), (P.ROMAN_NUMBER, "NUM_lat"))


def close_hanging(text: Column) -> Column:
    """Without a span from one opener to the next of its kind that no closer interrupts."""
    return _replace(text, (P.HANGING_PARENTHESIS, ""), (P.HANGING_BRACKET, ""))


def tidy_spaces(text: Column, marks: bool = False) -> Column:
    """Single spaces, none before a period or comma, no em spaces; with marks, no percent sign or asterisk before a
    space either."""
    text = _replace(text, (" +", " "), (EM_SPACE, ""), (r" \.", "."), (" ,", ","))
    return _replace(text, (r"[%*] ", "")) if marks else text


def strip_glued_numbers(text: Column) -> Column:
    return F.regexp_replace(text, P.GLUED_NUMBER, "")


def sentences(text: Column) -> Column:
    """Sentences: cut at white space after a period, ! or ? (with closing marks), blank ones left out."""
    cut = F.split(text, r"(?U)(?<=[.!?][)\"»”]?)\s+")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def wanted_sentence(sentence: Column, alphabet: str = "cyrillic") -> Column:
    """Whether a sentence has a letter of the alphabet and none of the masks."""
    return ~sentence.rlike("UNK|QUOTE|STYLE") & sentence.rlike(f"[{P.ALPHABETS[alphabet]}]")


def long_worded(sentence: Column, least: int = 5, mean: float = 5.0) -> Column:
    """Whether it has at least least words but for number masks, and these are longer than mean on average."""
    words = F.filter(F.split(sentence, r"(?U)\s+"), lambda w: (w != "") & (w != "NUM_arab"))
    total = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    return (F.size(words) >= least) & (total > mean * F.size(words))


def well_formed(sentence: Column, alphabet: str = "cyrillic") -> Column:
    """long_worded(), starting with a capital or a number mask, ending with a period, without //."""
    capital = {"cyrillic": "А-ЯЁN", "latin": "A-ZÀ-ÖØ-Þ"}[alphabet]
    return long_worded(sentence) & sentence.rlike(f"^[{capital}]") & sentence.rlike(r"\.$") & ~sentence.contains("//")


def unless_short(old: Column, new: Column, share: float = 0.7) -> Column:
    """new, if it has more than share of old's characters, else old; share is taken as the decimal that it is written as, so that
    exactly so many are not more."""
    return F.when(F.length(new) > F.lit(Decimal(str(share))) * F.length(old), new).otherwise(old)


def strip_beginning(text: Column) -> Column:
    """Each line's beginning up to the word for introduction becomes that word."""
    return F.regexp_replace(text, r"(?md)(?:^|\G).*?Введение(?:\.)?", "Введение. ")


def strip_ending(text: Column, words: str = P.BIBLIOGRAPHY) -> Column:
    return unless_short(text, F.regexp_replace(text, rf"(?s)(?:{words})\.?.*", ""))


def strip_quotations(text: Column) -> Column:
    return unless_short(text, F.regexp_replace(text, P.SHORT_QUOTE, ""))


def strip_square(text: Column) -> Column:
    return unless_short(text, F.regexp_replace(text, r"(?d)\[(.*?)\]", ""))


def share_of(text: Column, alphabet: str = "cyrillic") -> Column:
    """The share of the characters that are letters of the alphabet; null for an empty text."""
    return F.length(F.regexp_replace(text, f"[^{P.ALPHABETS[alphabet]}]", "")) / F.nullif(F.length(text), F.lit(0))


def strip_bad_sentences(text: Column, alphabet: str = "cyrillic", share: float = 0.3) -> Column:
    """Without sentences (between periods) that have five single characters in a row as words, or no more than share
    letters of the alphabet."""
    good = F.filter(F.split(text, r"\."), lambda s: ~s.rlike(P.LETTER_SPACED + r"(?:\s|$)") & (F.coalesce(share_of(s, alphabet), F.lit(0.0)) > share))
    return F.array_join(good, ".")


def mask_urls(text: Column) -> Column:
    """E-mail addresses deleted, web addresses and a/b/c to URL."""
    return _replace(text, (P.EMAIL, ""), (P.HTTPS, "URL"), (P.SLASHES, "URL"))


def tidy_legacy(text: Column) -> Column:
    """Single spaces, runs of white space to a paragraph break, some characters of broken encodings deleted, one kind
    of quote."""
    text = _replace(text, ("[ ]{2,}", " "), (r"(?U)\s{2,}", "\n\n"), (f"[{P.FOREIGN_CHARACTERS}]", ""))
    return F.regexp_replace(text, "[«»“”„]", '"')


def strip_line_hyphens(line: Column) -> Column:
    """Without hyphens after Cyrillic letters, but for those after the listed words."""
    kept = F.regexp_replace(line, rf"(?iu)({P.KEPT_HYPHENS})-", "$1--")
    return F.regexp_replace(kept, "([А-яЁё])-", "$1")
