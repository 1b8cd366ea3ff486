"""Column builders on text. Offsets are 0-based code points; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters of the lower-case text. (The engine's one tokenizer; apostrophes and digits end a word.)
WORD = r"\p{L}+"
#: A token is a run of other characters with the blanks before it; blanks at the end are one too.
TOKEN = r"[ \n]*[^ \n]+|[ \n]+"
#: Characters that make a word boundary matter: letters, numbers and marks.
WORD_CHAR = r"[\p{L}\p{N}\p{M}]"

#: The customary list of English stopwords.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven "
    "isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def quoted(literal: str) -> str:
    """A literal as a pattern."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and however deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items that one fold goes through. A fold that collects copies what it has at each step, so long arrays are folded part by part.
PART = 256


def parted(items: Column, moved: Callable[[Column, Column], Column], of: Callable[[Column, Column], Column]) -> Column:
    """``of(part, at)`` for each ``PART`` items, where ``at`` is what ``moved(at, item)`` makes of 0 over all items before."""
    numbers = lambda a: F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / PART).cast("int"))
    parts = lambda a: F.transform(numbers(a), lambda k: F.slice(a, k * PART + 1, F.lit(PART)))
    begun = lambda ps: F.aggregate(ps, F.array(F.lit(0)), lambda out, p: F.concat(out, F.array(F.aggregate(p, F.element_at(out, -1), moved))))
    each = lambda ps: F.transform(F.arrays_zip(ps.alias("part"), F.slice(begun(ps), F.lit(1), F.size(ps)).alias("at")), lambda z: of(z["part"], z["at"]))
    return let(items, lambda a: let(parts(a), each))


def lower(c: Column) -> Column:
    """Lower case, character for character: offsets stay. The one letter whose lower case is two characters, U+0130, is left as it is."""
    return F.when(F.contains(c, F.lit("\u0130")), F.array_join(F.transform(F.split(c, "\u0130", -1), F.lower), "\u0130")).otherwise(F.lower(c))


def lowered(s: str) -> str:
    """The same for a string."""
    return "\u0130".join(x.lower() for x in s.split("\u0130"))


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column, least: int = 1, stopwords: Sequence[str] = ()) -> Column:
    """The words of a text in order, those too short and stopwords left out."""
    found = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    if least > 1 or stopwords:
        found = F.filter(found, lambda w: (F.length(w) >= least) & (~w.isin(list(stopwords)) if stopwords else F.lit(True)))
    return found


def ngrams(ws: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by blanks."""
    if n == 1:
        return ws
    return F.transform(shifted(ws, n), lambda x: F.concat_ws(" ", *[x[str(k)] for k in range(n)]))


def shifted(items: Column, n: int) -> Column:
    """Each n neighbours of an array, as structs with fields 0 to n - 1."""

    def cut(a: Column) -> Column:
        last = F.greatest(F.size(a) - (n - 1), F.lit(0))
        return F.arrays_zip(*[F.slice(a, F.lit(k + 1), last).alias(str(k)) for k in range(n)])

    return let(items, cut)


def first_start(c: Column, pattern: str) -> Column:
    """Where a pattern first matches; null if nowhere. (What precedes the match is measured: positions from regexp_instr are UTF-16.)"""
    return F.when(c.rlike(pattern), start_of(c, pattern))


def start_of(c: Column, pattern: str) -> Column:
    """The same where a match is known."""
    return F.length(F.get(F.split(c, pattern, 2), F.lit(0)))


#: Characters that mark places in a text on the way; texts that hold one themselves go another way.
MARKS = ("\u0001", "\u0002")


def unmarked(c: Column) -> Column:
    """Whether a text holds none of the marks."""
    return ~(F.contains(c, F.lit(MARKS[0])) | F.contains(c, F.lit(MARKS[1])))


def spans(c: Column, pattern: str) -> Column:
    """``array<struct<start, match>>`` of the leftmost non-overlapping matches. The pattern runs once over the text."""
    empty = F.array().cast("array<struct<start:int,match:string>>")
    pieces = F.split(F.regexp_replace(c, pattern, f"{MARKS[0]}$0{MARKS[0]}"), MARKS[0], -1)  # gap, match, gap, ..., gap
    every = lambda rest: lambda ps: F.filter(ps, lambda x, i: i % 2 == rest)
    quick = let(pieces, lambda ps: F.arrays_zip(every(0)(ps).alias("gap"), every(1)(ps).alias("match")))
    slow = F.arrays_zip(F.split(c, pattern, -1).alias("gap"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("match"))
    after = lambda at, x: at + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        more = F.when(x["match"].isNotNull(), F.concat(s["out"], F.array(F.struct(start.alias("start"), x["match"].alias("match"))))).otherwise(s["out"])
        return F.struct((start + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"), more.alias("out"))

    def placed(steps: Column) -> Column:
        return F.flatten(parted(steps, after, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])))

    return let(F.when(unmarked(c), quick).otherwise(slow), lambda steps: F.when(F.size(steps) > 1, placed(steps)).otherwise(empty))


#: Where a token ends and the next begins: a token begins with its blanks.
TOKEN_EDGE = r"[^ \n][ \n]"


def token_at(c: Column, start: Column) -> Column:
    """The number of the token that holds the character at ``start``; null beyond the text."""
    return F.when((start >= 0) & (start < F.length(c)), F.regexp_count(F.substring(c, F.lit(1), start + 1), F.lit(TOKEN_EDGE)))


def tokens_after(c: Column, start: Column, then: Column) -> Column:
    """How many tokens further on than the character at ``start`` the one at ``then`` is."""
    return F.regexp_count(F.substring(c, start + 1, then - start + 1), F.lit(TOKEN_EDGE))


def only(value: Column) -> Column:
    """A generator of one row, or of none where the value is null. (A filter on the value would work it out a second time.)"""
    return F.explode(F.array_compact(F.array(value)))


def snippet(c: Column, start: Column, length: Column, around: int) -> Column:
    """The text around a match, line ends as blanks."""
    begin = F.greatest(start - around, F.lit(0))
    return F.translate(F.substring(c, begin + 1, start + length + around - begin), "\n", " ")
