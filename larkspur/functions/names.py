"""Names of teams, leagues and markets: normalisation, tokens, flags and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.prob import bind

#: Fixed values.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñý"
PLAIN = "aaaaaaeeeeiiiiooooouuuucny"
STOP = "fc cf ec sc ca ac afc club clube futebol if bk sl sk ik fk cs cd ud umf".split()
STATES = "pr|sp|rj|mg|rs|go|ce|pe|ba|mt|ms|pa|to|al|se|rn|pb|pi|ap|ac|ro|rr|df"
#: League classes in the order in which they are tried, as (class, pattern).
LEAGUES = (
    ("sula", "sudamericana|sul-americana|sul americana|sulamericana"),
    ("liberta", "libertadores"),
    ("mls", r"major league soccer|\bmls\b"),
    ("mx", "liga mx|ligamx|mexic.*(liga|apertura|clausura)|(liga|apertura|clausura).*mexic"),
    ("br-b", "serie b|serie-b|br-b"),
    ("br-c", "serie c"),
    ("br-a", "brasileir|serie a|br-a"),
    ("wc", "world cup|copa do mundo|^ *wc *$|fifa"),
    ("br-cdb", "copa.*brasil|brasil.*copa"),
    ("epl", "premier league|premier.*ingl|ingl.*premier"),
    ("laliga", "laliga|la liga"),
    ("ucl", "champions"),
    ("allsv", "allsvenskan"),
    ("uy", "uruguay|uruguai|auf"),
    ("ec", "ecuad|ligapro"),
    ("csl", "china|csl"),
    ("ru", "russia"),
)
MIN_TOKEN = 4
#: Marks of women's, second, reserve and youth sides.
FLAGS = "f fem w b ii r res sub jr u17 u19 u20 u21 u23".split()
#: Words of many clubs' names, which say nothing alone.
WEAK = (
    "sporting sport united unidos city club clube real atletico atletica athletic nacional national deportivo deportiva deportes racing independiente"
    " internacional inter universidad universitario universidade america juventud juventude union olimpia olimpic olympic central junior"
).split()
#: Score of two names of which a word holds the other's.
HELD = 92.0


def plain(text: Column) -> Column:
    """Lower-cased, without accents; null is empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def norm_team(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Team key: dotted abbreviations joined, aliases, state suffix and club words dropped.

    Aliases are a map of bounded size; they are looked up before the state suffix goes, after it, and last.
    """
    table = F.create_map(*[F.lit(x) for kv in (aliases or {}).items() for x in kv]) if aliases else None
    alias = lambda c: F.try_element_at(table, c) if table is not None else F.lit(None).cast("string")
    joined = F.regexp_replace(F.regexp_replace(F.trim(plain(name)), r"\b([a-z])\.\s?([a-z])\.\s?([a-z])\.?", "$1$2$3"), r"\b([a-z])\.\s?([a-z])\.?", "$1$2")

    def dropped(s: Column) -> Column:
        kept = F.array_join(F.filter(F.split(s, " "), lambda t: ~t.isin(*STOP)), " ")
        return bind(F.when(kept == "", s).otherwise(kept), lambda k: F.coalesce(alias(k), k))

    def last(s: Column) -> Column:
        return F.coalesce(alias(s), dropped(s))

    return bind(joined, lambda s: F.coalesce(alias(_squeezed(s)), bind(_squeezed(F.regexp_replace(s, f"[- ]({STATES})$", "")), last)))


def tokens(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda t: F.length(t) >= MIN_TOKEN)


def league_class(league: Column) -> Column:
    """The first class whose pattern is in the league's name; null if none is."""
    text = plain(league)
    out = F.when(text.rlike(LEAGUES[0][1]), LEAGUES[0][0])
    for name, pattern in LEAGUES[1:]:
        out = out.when(text.rlike(pattern), name)
    return out


def leagues_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


#: Characters of a name whose places fit in the bits of a long, with room for a sum.
BITS = 61


def _lcs_bits(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of arrays of characters, x of BITS at most: a zero bit for each place of x that is in it."""
    one = F.lit(1).cast("long")
    placed = F.transform(x, lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", one, i).alias("bit")))
    full = F.call_function("shiftleft", one, F.size(x)) - 1

    def fold(bits: Column, whole: Column) -> Column:
        def step(v: Column, c: Column) -> Column:
            at = F.aggregate(bits, F.lit(0).cast("long"), lambda m, e: F.when(e["c"] == c, m + e["bit"]).otherwise(m))
            return bind(v.bitwiseAND(at), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(whole))

        return F.size(x) - F.bit_count(F.aggregate(y, whole, step))

    return bind(placed, lambda bits: bind(full, lambda whole: fold(bits, whole)))


def _lcs_rows(x: Column, y: Column) -> Column:
    """The same for names of any length: the table's rows are folded over the characters of x."""

    def row(previous: Column, c: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            left = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
            diagonal = F.when(i > 0, F.get(previous, i - 1)).otherwise(F.lit(0))
            best = F.when(F.get(y, i) == c, diagonal + 1).otherwise(F.greatest(left, F.get(previous, i)))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.transform(y, lambda _, i: i), F.array().cast("array<int>"), cell)

    return F.coalesce(F.try_element_at(F.aggregate(x, F.transform(y, lambda _: F.lit(0)), row), F.lit(-1)), F.lit(0))


def _indel(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (len a + len b)."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def lcs(x: Column, y: Column) -> Column:
        return F.when(F.size(x) <= BITS, _lcs_bits(x, y)).when(F.size(y) <= BITS, _lcs_bits(y, x)).otherwise(_lcs_rows(x, y))

    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * bind(chars(a), lambda x: bind(chars(b), lambda y: lcs(x, y))) / total)


def _held(shared: Column, whole: Column) -> Column:
    """_indel of a text and one that begins with it."""
    return 200.0 * F.length(shared) / (F.length(shared) + F.length(whole))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best Indel similarity of common and differing tokens; 100 if one's tokens hold the other's."""
    words = lambda s: F.array_sort(F.array_distinct(F.array_remove(F.split(s, " "), "")))

    def compare(x: Column, y: Column) -> Column:
        both, only_x, only_y = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
        join = lambda *parts: F.array_join(F.concat(*parts), " ")
        shared, left, right = join(both), join(both, only_x), join(both, only_y)
        return (
            F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
            .when((F.size(both) > 0) & ((F.size(only_x) == 0) | (F.size(only_y) == 0)), 100.0)
            .when(F.size(both) == 0, _indel(left, right))
            .otherwise(F.greatest(_indel(left, right), _held(shared, left), _held(shared, right)))
        )

    return bind(words(a), lambda x: bind(words(b), lambda y: compare(x, y)))


def strip_weak(name: Column) -> Column:
    return F.array_join(F.filter(F.split(name, " "), lambda t: (t != "") & ~t.isin(*WEAK)), " ")


def side_hit(a: Column, b: Column) -> Column:
    """token_set_ratio, at least HELD if a word of one holds a word of the other; 0 if a name is empty."""
    held = F.exists(tokens(a), lambda x: F.exists(tokens(b), lambda y: x.contains(y) | y.contains(x)))
    score = bind(token_set_ratio(a, b), lambda r: F.when(held, F.greatest(r, F.lit(HELD))).otherwise(r))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(score)


def side_hit_strong(a: Column, b: Column) -> Column:
    """side_hit without weak words; names of weak words only give 0."""
    return bind(strip_weak(a), lambda x: bind(strip_weak(b), lambda y: side_hit(x, y)))


def flags(name: Column) -> Column:
    """The marks in a name, sorted, as text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), " "), lambda t: t.isin(*FLAGS)))), " ")


def pair_flags(home: Column, away: Column) -> Column:
    """The marks of both sides, whichever is at home."""
    return F.array_sort(F.array(flags(home), flags(away)))


def aliased(names: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """names with the alias of the column name, by a join with a dimension aliases(alias, name)."""
    dim = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("name").alias("_name"))
    return names.join(dim, F.col(name) == F.col("_alias"), "left").withColumn(name, F.coalesce("_name", name)).drop("_alias", "_name")
