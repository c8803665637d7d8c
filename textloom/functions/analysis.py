"""Analysis chains as Column expressions: tokenizers, token mergers and normalizers.

All run inside Spark's generated code. The default word is a maximal run of
Unicode letters and numbers of the lower-cased text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with the value computed once; inside a lambda an expression is computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# tokenizers


def words(text: Column | str, pattern: str = WORD) -> Column:
    """All matches of a pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), F.lit(0))


def find_tokens(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def split_tokens(text: Column | str, pattern: str = r"\s+") -> Column:
    """Split at a pattern; empty pieces stay."""
    return F.split(_col(text), pattern, -1)


def sub_tokens(text: Column | str, pattern: str) -> Column:
    """What the pattern matches becomes a space; then split at white space."""
    return F.split(F.trim(F.regexp_replace(_col(text), pattern, " ")), r"\s+")


def lines(text: Column | str) -> Column:
    return F.split(_col(text), "\n", -1)


def offsets(text: Column | str, tokens: Column) -> Column:
    """Where each token begins in the text, counted in characters, in order of the tokens."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, token: Column) -> Column:
        at = F.call_function("locate", token, _col(text), acc["at"] + 1) - 1
        return F.struct((at + F.length(token)).alias("at"), F.concat(acc["found"], F.array(at)).alias("found"))

    return F.aggregate(tokens, start, step, lambda acc: acc["found"])


# token mergers


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Runs of n tokens."""
    def runs(t: Column) -> Column:
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(t, i, n), sep))

    return let(tokens, runs)


def counted(tokens: Column) -> Column:
    """(term, rec, occ): a row's distinct terms with rec 1, and all its tokens with occ 1; their sums by term count rows and occurrences with one shuffle."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    recs = F.transform(F.array_distinct(tokens), lambda x: F.struct(x.alias("term"), one.alias("rec"), none.alias("occ")))
    return F.concat(recs, F.transform(tokens, lambda x: F.struct(x.alias("term"), none.alias("rec"), one.alias("occ"))))


def positions(tokens: Column, term: str) -> Column:
    """Where the term stands, from 0."""
    return F.filter(F.transform(tokens, lambda x, i: F.when(x == term, i)), lambda x: x.isNotNull())


def range_ends(tokens: Column) -> Column:
    """min/max of the tokens, as one term."""
    return F.concat_ws("/", F.array_min(tokens), F.array_max(tokens))


def pairs_as_ranges(tokens: Column) -> Column:
    """Each two tokens in a row make one range term; a last one without a partner makes a range of itself."""
    n = F.size(tokens)
    begins = F.filter(F.sequence(F.lit(0), n), lambda i: (i % 2 == 0) & (i < n))
    return F.transform(begins, lambda i: F.concat_ws("/", F.get(tokens, i), F.get(tokens, F.least(i + 1, n - 1))))


# normalizers


def lower(c: Column | str) -> Column:
    return F.lower(_col(c))


def reverse(c: Column | str) -> Column:
    return F.reverse(_col(c))


def spaces(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def article(c: Column | str) -> Column:
    """Without a leading article."""
    return F.regexp_replace(_col(c), r"(?i)^(the|an|a) ", "")


def possessive(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"'s$", ""), r"s'$", "s")


def zero_pad(c: Column | str, width: int = 12) -> Column:
    """Integers padded with zeros to a width, so that they sort as strings; null if it isn't one."""
    return F.lpad(_col(c).try_cast("bigint").cast("string"), width, "0")


def as_integer(c: Column | str) -> Column:
    return _col(c).try_cast("bigint")


def exists(c: Column | str) -> Column:
    """'1' if there is any data, else '0'."""
    return F.when(F.coalesce(_col(c), F.lit("")) != "", "1").otherwise("0")


def without_stops(tokens: Column, stops: list[str]) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(stops))


def strip_pattern(c: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_col(c), pattern, by)


def keep_pattern(c: Column | str, pattern: str) -> Column:
    return F.array_join(find_tokens(c, pattern), "")


#: Each plain character, and the ones that become it.
_PLAIN = {
    "/": "÷",
    "A": "ÀÁÂÃÄÅĀĂĄǍǞǺȀȂȦḀẠẢẤẦẨẪẬẮẰẲẴẶ",
    "B": "ḂḄḆ",
    "C": "ÇĆĈĊČḈ",
    "D": "ÐĎĐǄǅǱǲḊḌḎḐḒ",
    "E": "ÈÉÊËĒĔĖĘĚȄȆȨḔḖḘḚḜẸẺẼẾỀỂỄỆ",
    "F": "Ḟ",
    "G": "ĜĞĠĢǦǴḠ",
    "H": "ĤĦȞḢḤḦḨḪ",
    "I": "ÌÍÎÏĨĪĬĮİĲǏȈȊḬḮỈỊ",
    "J": "Ĵ",
    "K": "ĶǨḰḲḴ",
    "L": "ĹĻĽĿŁǇǈḶḸḺḼ",
    "M": "ḾṀṂ",
    "N": "ÑŃŅŇŊǊǋǸṄṆṈṊ",
    "O": "ÒÓÔÕÖØŌŎŐƠǑǪǬȌȎȪȬȮȰṌṎṐṒỌỎỐỒỔỖỘỚỜỞỠỢ",
    "P": "ṔṖ",
    "R": "ŔŖŘȐȒṘṚṜṞ",
    "S": "ŚŜŞŠȘṠṢṤṦṨ",
    "T": "ŢŤŦȚṪṬṮṰ",
    "U": "ÙÚÛÜŨŪŬŮŰŲƯǓǕǗǙǛȔȖṲṴṶṸṺỤỦỨỪỬỮỰ",
    "V": "ṼṾ",
    "W": "ŴẀẂẄẆẈ",
    "X": "ẊẌ",
    "Y": "ÝŶŸȲẎỲỴỶỸ",
    "Z": "ŹŻŽẐẒẔ",
    "a": "àáâãäåāăąǎǟǻȁȃȧḁẚạảấầẩẫậắằẳẵặ",
    "b": "ḃḅḇ",
    "c": "çćĉċčḉ",
    "d": "ðďđǆǳḋḍḏḑḓ",
    "e": "èéêëēĕėęěȅȇȩḕḗḙḛḝẹẻẽếềểễệ",
    "f": "ḟ",
    "g": "ĝğġģǧǵḡ",
    "h": "ĥħȟḣḥḧḩḫẖ",
    "i": "ìíîïĩīĭįıĳǐȉȋḭḯỉị",
    "j": "ĵǰ",
    "k": "ķĸǩḱḳḵ",
    "l": "ĺļľŀłǉḷḹḻḽ",
    "m": "ḿṁṃ",
    "n": "ñńņňŋǌǹṅṇṉṋ",
    "o": "òóôõöøōŏőơǒǫǭȍȏȫȭȯȱṍṏṑṓọỏốồổỗộớờởỡợ",
    "p": "ṕṗ",
    "r": "ŕŗřȑȓṙṛṝṟ",
    "s": "śŝşšſșṡṣṥṧṩ",
    "t": "ţťŧțṫṭṯṱẗ",
    "u": "ùúûüũūŭůűųưǔǖǘǚǜȕȗṳṵṷṹṻụủứừửữự",
    "v": "ṽṿ",
    "w": "ŵẁẃẅẇẉẘ",
    "x": "×ẋẍ",
    "y": "ýÿŷȳẏẙỳỵỷỹ",
    "z": "źżžẑẓẕ",
    "Æ": "ǢǼ",
    "Ø": "Ǿ",
    "æ": "ǣǽ",
    "ø": "ǿ",
    "ſ": "ẛ",
    "Ʒ": "Ǯ",
    "Ȧ": "Ǡ",
    "ȧ": "ǡ",
    "ʒ": "ǯ",
    "ʼ": "ŉ",
}
_ACCENTS = str.maketrans({x: plain for plain, marked in _PLAIN.items() for x in marked})
_SPELT = (("©", "(c)"), ("Æ", "AE"), ("Œ", "OE"), ("§", "Section"), ("Þ", "TH"), ("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th"))


def without_accents(c: Column | str) -> Column:
    """Letters without their marks, each replaced once; ligatures and the signs of section and copyright are spelt out."""
    spelt = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _SPELT, _col(c))
    return F.translate(spelt, "".join(map(chr, _ACCENTS)), "".join(_ACCENTS.values()))


_SOUNDS = (("[aehiouwy]", "0"), ("[bpfv]", "1"), ("[cgjkqsxz]", "2"), ("[dt]", "3"), ("l", "4"), ("[mn]", "5"), ("r", "6"))


def phonetic(c: Column | str, size: int = 0) -> Column:
    """The first letter and the classes of the consonants after it, repetitions as one; padded or cut to a size if one is given."""
    word = F.regexp_replace(F.lower(_col(c)), "[^a-z]", "")
    rest = F.substr(word, F.lit(2))
    for sound, digit in _SOUNDS:
        rest = F.regexp_replace(rest, sound, digit)
    rest = F.replace(F.regexp_replace(rest, r"(\d)\1+", "$1"), F.lit("0"), F.lit(""))
    code = F.concat(F.substring(word, 1, 1), rest)
    return F.rpad(code, size, "0") if size else code


def smash_html(c: Column | str) -> Column:
    """Text of a page: no head, scripts, styles, comments or tags; white space as single spaces."""
    text = _col(c)
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?is)<head.*?</head>", r"(?is)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")
