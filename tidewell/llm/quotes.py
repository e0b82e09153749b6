"""Quotation linking: nested quotes are parsed, their passages linked to original messages, and threads rebuilt without quotes."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows, materialize

QUOTED = re.compile(r"((?:>[ \t]?)+)(.*)", re.S)
#: A line that announces a quote; it goes with the quotes if one follows it.
ANNOUNCES = re.compile(r"On .{1,200} wrote:\s*\Z")


def passage_key(text: str) -> str | None:
    """Digest of a passage without case and spacing; None for one without a word."""
    plain = " ".join(text.lower().split())
    return hashlib.md5(plain.encode("utf-8", "surrogatepass")).hexdigest() if plain else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text): consecutive lines of one level form a passage."""
    own, passages = [], []
    for line in (text or "").split("\n"):
        if m := QUOTED.match(line):
            level = m[1].count(">")
            if passages and passages[-1][2] and passages[-1][0] == level:
                passages[-1][1].append(m[2])
            else:
                if own and ANNOUNCES.match(own[-1]):
                    own.pop()
                if passages:
                    passages[-1][2] = False
                passages.append([level, [m[2]], True])
        else:
            if passages:
                passages[-1][2] = False
            own.append(line)
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines, _ in passages]


def part_keys(text: str) -> list[str]:
    """Keys of the paragraphs and lines of a text, each once, without that of the whole."""
    found = dict.fromkeys(passage_key(p) for p in [*re.split(r"\n\s*\n", text), *text.split("\n")])
    return [k for k in found if k and k != passage_key(text)]


def numbered(messages: DataFrame) -> DataFrame:
    """messages with a row id, written so that it stays the same in all that follows; as they are if they have one."""
    return messages if "row" in messages.columns else materialize(messages.withColumn("row", F.monotonically_increasing_id()))


def parse_messages(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, role, tie, body, body_key, parts, passages) of each message; a null text counts as empty.

    parts are the keys of the body's paragraphs and lines, a passage's parts those of its own. tie is a hash of role and text.
    """

    def make():
        def step(rows, convs, turns, roles, ties, texts):
            got = [parse(t) for t in texts]
            passages = [[{"level": n, "key": k, "parts": part_keys(p)} for n, p in ps if (k := passage_key(p))] for _, ps in got]
            return rows, convs, turns, roles, ties, [b for b, _ in got], [passage_key(b) for b, _ in got], [part_keys(b) for b, _ in got], passages

        return step

    rows = numbered(messages).select("row", "conv_id", "turn", "role", F.xxhash64("role", "text").alias("tie"), "text")
    return map_rows(rows, make, "row long, conv_id long, turn long, role string, tie long, body string, body_key string, parts array<string>, passages array<struct<level:long,key:string,parts:array<string>>>")


def _originals(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first message of each key: of (conv_id, key), as whole and piece; and of key, as `others`, those of the two least conv_ids for each of both."""
    keys = F.concat(F.array(F.struct(F.col("body_key").alias("key"), F.lit(0).alias("kind"))), F.transform("parts", lambda k: F.struct(k.alias("key"), F.lit(1).alias("kind"))))
    keyed = parsed.where("body_key IS NOT NULL").select("conv_id", F.struct("turn", "tie", "row").alias("at"), F.explode(keys).alias("k")).select("conv_id", "at", "k.key", "k.kind")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    in_conv = materialize(keyed.groupBy("conv_id", "key").agg(first(0).alias("whole"), first(1).alias("piece")))
    each = in_conv.select("key", "conv_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("whole").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("piece").alias("at")))).alias("x")).where("x.at IS NOT NULL").select("key", "x.kind", "conv_id", "x.at")
    least = each.withColumn("_n", F.row_number().over(Window.partitionBy("key", "kind").orderBy("conv_id"))).where("_n <= 2")  # limited to two before the shuffle, too
    return in_conv, least.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "conv_id", "at"))).alias("others"))


def _find(asked: DataFrame, in_conv: DataFrame, of_all: DataFrame) -> DataFrame:
    """asked with the message that its key names, as `found`; without the rows whose key names none."""
    before = lambda c: F.when(F.col(f"{c}.turn") < F.col("turn"), F.struct("conv_id", F.col(c).alias("at")))
    own = asked.join(in_conv, ["conv_id", "key"], "left").withColumn("own", F.coalesce(before("whole"), before("piece"))).drop("whole", "piece")
    other = F.get(F.filter("others", lambda o: o["conv_id"] != F.col("conv_id")), F.lit(0))
    found = F.coalesce("own", F.when(other.isNotNull(), F.struct(other["conv_id"].alias("conv_id"), other["at"].alias("at"))))
    return own.join(of_all, "key", "left").withColumn("found", found).where("found IS NOT NULL").select(*asked.columns, "found")


def link_rows(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, role, body, n_quotes, max_level, links, parent_conv, parent_turn, root_turn, depth, position) of each row of messages.

    A passage names an original by the key of its whole text: within the conversation the first earlier
    message of that own text, else the first earlier one with such a paragraph or line; else, of all
    others, the first message of the least conv_id, whole texts before parts. A passage that names none
    that way is asked for again by its own paragraphs and lines. links holds all (level, nth, part, conv_id,
    turn) in order, part 0 being the passage as a whole; the first of the lowest level is the parent. Keys are
    reduced to one original for each conversation and two of all before any join, so a passage quoted
    by a third of all messages makes no pairs.

    root_turn and depth follow parents within the conversation; a message without one, or with one of another
    conversation only, is a root. position is the place from 1 of a message when its conversation is read depth first: a message,
    then its replies by turn, hash of role and text, and row, each with all that answers it. Repeats of (conv_id, turn) are
    messages of their own: where several could be an original, that of the least hash of role and text is.
    Rows of a null conv_id or turn come back without links, as roots without a position.
    """
    parsed = materialize(parse_messages(messages))
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    in_conv, of_all = _originals(placed)
    asked = placed.select("row", "conv_id", "turn", F.posexplode("passages").alias("nth", "p")).select("row", "conv_id", "turn", "nth", "p.level", F.lit(0).alias("part"), "p.key", "p.parts")
    whole = materialize(_find(asked.drop("parts"), in_conv, of_all))
    parts = asked.where(F.size("parts") > 0).join(whole.select("row", "nth"), ["row", "nth"], "left_anti").select("row", "conv_id", "turn", "nth", "level", F.posexplode("parts").alias("at", "key"))
    parts = parts.select("row", "conv_id", "turn", "nth", "level", (F.col("at") + 1).alias("part"), "key")
    hit = whole.unionByName(_find(parts, in_conv, of_all))
    one = F.struct("level", "nth", "part", F.col("found.conv_id").alias("conv_id"), F.col("found.at.turn").alias("turn"), F.col("found.at.row").alias("to"))
    best = hit.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("found"))
    parent = F.get("found", F.lit(0))
    links = F.transform(F.coalesce("found", F.array().cast("array<struct<level:long,nth:int,part:int,conv_id:long,turn:long,to:long>>")), lambda x: x.dropFields("to"))
    level = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level")
    linked = materialize(
        parsed.join(best, "row", "left").select("row", "conv_id", "turn", "tie", "role", "body", F.size("passages").cast("long").alias("n_quotes"), level, links.alias("links"), parent["conv_id"].alias("parent_conv"), parent["turn"].alias("parent_turn"), parent["to"].alias("to"))
    )
    return _ordered(linked).drop("tie", "to")


def link_quotes(messages: DataFrame) -> DataFrame:
    """link_rows of the distinct messages of a conv_id and turn that aren't null, without their row ids."""
    return link_rows(messages.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()).drop("row")


def _follow(rows: DataFrame, **merge) -> DataFrame:
    """rows (row, at, ...) when every `at`, a row or null, is followed until null. A round doubles how far that is, for those still
    going: merge has the new value of each other column from its own and, under names with _ before, those of the row at `at`."""
    going, done = rows.where("at IS NOT NULL"), rows.where("at IS NULL")
    while not going.isEmpty():
        other = going.unionByName(done).select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
        new = materialize(going.join(other, F.col("at") == F.col("_row")).select("row", F.col("_at").alias("at"), *[e.alias(c) for c, e in merge.items()]))
        going, done = new.where("at IS NOT NULL"), done.unionByName(new.where("at IS NULL"))
    return done.drop("at")


def _ordered(linked: DataFrame) -> DataFrame:
    """Adds root_turn, depth and position.

    Behind a message comes its first reply or, without replies, the next sibling of the nearest message above it, itself
    included, that has one. What each message comes behind is followed to the start, which gives its position.
    """
    inside = F.coalesce(F.col("parent_conv") == F.col("conv_id"), F.lit(False))
    usable = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    nodes = linked.select("row", "conv_id", "turn", "tie", F.when(inside, F.col("to")).alias("at"), F.when(usable, F.when(inside, F.col("to")).otherwise(-1)).alias("above"))
    nodes = materialize(_nth(nodes.where("above IS NOT NULL")).unionByName(nodes.where("above IS NULL").withColumn("nth", F.lit(None).cast("long"))))
    placed = nodes.where("above IS NOT NULL")
    before = placed.select("conv_id", "above", (F.col("nth") - 1).alias("nth"), F.col("row").alias("sibling"))
    tree = materialize(nodes.join(before, ["conv_id", "above", "nth"], "left").select("row", "at", "above", "nth", "sibling", F.when(F.col("at").isNull(), F.col("turn")).alias("root_turn"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    root = _follow(tree.select("row", "at", "root_turn", "depth", "sibling"), root_turn=F.col("_root_turn"), depth=F.col("depth") + F.col("_depth"), sibling=F.coalesce("sibling", "_sibling"))
    root = materialize(root)
    child = tree.where("nth = 1 AND at IS NOT NULL").select(F.col("at").alias("row"), F.col("row").alias("child"))
    behind = root.join(child, "row", "left").select(F.col("row").alias("at"), F.coalesce("child", "sibling").alias("row")).where("row IS NOT NULL")
    chain = materialize(placed.select("row").join(behind, "row", "left").withColumn("position", F.lit(1).cast("long")))
    position = _follow(chain, position=F.col("position") + F.col("_position"))
    return linked.join(root.drop("sibling"), "row").join(position, "row", "left")


def _nth(rows: DataFrame, least: int = 500, buckets: int = 64) -> DataFrame:
    """Adds nth, the place from 1 of a row among those of its conv_id and `above`, by turn, tie and row.

    Those of more than `least` rows and of more than 1 in 4,096 of all are cut into buckets at approximate quantiles of the turn,
    where a turn that is a cut has a bucket of its own, dealt on by the beginning of tie. Each bucket is ordered by
    itself, so no task sorts a large one; where the cuts lie doesn't change the result, since no bucket's rows lie among another's.
    The cuts of the large ones, 4,096 at most, are broadcast. Only exact repeats (of turn, role and text) share a bucket always, and
    turns beyond 2^53 that are the same as doubles.
    """
    keys, turn = ["conv_id", "above"], F.col("turn").cast("double")
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(least, rows.count() // 4096)).select(*keys)
    edges = rows.join(F.broadcast(large), keys).groupBy(*keys).agg(F.array_distinct(F.percentile_approx(turn, [i / buckets for i in range(1, buckets)], 1000)).alias("_e"))
    edges = F.broadcast(materialize(edges))
    place = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy("turn", "tie", "row")).cast("long")
    cut = rows.join(edges, keys)
    among = 2 * F.size(F.filter("_e", lambda e: e < turn)) + F.array_contains("_e", turn).cast("int")
    part = F.when(F.array_contains("_e", turn) & (F.abs(turn) < 2.0**53), F.shiftright("tie", 58)).otherwise(0)  # tie is signed, as its order is
    cut = cut.withColumn("_b", F.struct(among.alias("among"), part.alias("part"))).drop("_e")
    sums = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    cut = cut.join(before, [*keys, "_b"]).withColumn("nth", F.col("_o") + place("_b")).drop("_b", "_o")
    return rows.join(edges, keys, "left_anti").withColumn("nth", place()).unionByName(cut)


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as mail threads: each message quotes the one before it, and that one's own quote a level deeper.

    One row for each row. Of several messages of a (conv_id, turn), the one of the least text, then role, is quoted.
    """
    own = numbered(conversations).select("row", "conv_id", "turn", "role", F.col("text").alias("said"))
    one = own.where("conv_id IS NOT NULL AND turn IS NOT NULL AND said IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("said", "role")).alias("m"))
    back = lambda k: one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("m.said").alias(f"said_{k}"), F.col("m.role").alias(f"role_{k}"))
    quote = lambda col, mark: F.concat(F.lit(mark), F.replace(F.col(col), F.lit("\n"), F.lit("\n" + mark)))
    joined = own.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    head = F.concat(F.lit("On turn "), F.col("turn") - 1, F.lit(", "), F.coalesce("role_1", F.lit("someone")), F.lit(" wrote:\n"))
    text = F.when(F.col("said_1").isNull(), F.col("said")).otherwise(F.concat(head, F.when(F.col("said_2").isNotNull(), F.concat(quote("said_2", "> > "), F.lit("\n"))).otherwise(""), quote("said_1", "> "), F.lit("\n"), F.coalesce("said", F.lit(""))))
    return joined.select("row", "conv_id", "turn", "role", text.alias("text"))


QUOTES_SQL = """
WITH RECURSIVE n AS (SELECT conv_id, turn, role, text, regexp_replace(regexp_replace(lower(text), '[\\s]+', ' ', 'g'), '^ | $', '', 'g') AS plain FROM conversations),
f AS (SELECT conv_id, plain, min(turn) AS first FROM n GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, f.first AS parent_turn FROM n a JOIN n b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 JOIN f ON f.conv_id = b.conv_id AND f.plain = b.plain),
d AS (SELECT n.conv_id, n.turn, n.role, n.text, p.parent_turn, (SELECT count(*) FROM n m WHERE m.conv_id = n.conv_id AND m.turn IN (n.turn - 1, n.turn - 2)) AS quotes FROM n LEFT JOIN p USING (conv_id, turn)),
t AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth, [turn] AS path FROM d WHERE parent_turn IS NULL UNION ALL SELECT d.conv_id, d.turn, t.root_turn, t.depth + 1, list_append(t.path, d.turn) FROM d JOIN t ON d.conv_id = t.conv_id AND d.parent_turn = t.turn)
SELECT conv_id, turn, role, sha256(text) AS body_sha256, quotes AS n_quotes, quotes AS max_level, quotes AS n_links, CASE WHEN parent_turn IS NOT NULL THEN conv_id END AS parent_conv, parent_turn, root_turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position
FROM d JOIN t USING (conv_id, turn)"""


def quotation_links(conversations: DataFrame) -> DataFrame:
    """The links, roots, depths and places of conversations written as mail, which the operator has to find again from the quotes alone.

    A row for each row, repeated and null-keyed ones included.
    """
    return link_rows(as_mail(conversations)).select("conv_id", "turn", "role", F.sha2("body", 256).alias("body_sha256"), "n_quotes", "max_level", F.size("links").cast("long").alias("n_links"), "parent_conv", "parent_turn", "root_turn", "depth", "position")


def threads(linked: DataFrame) -> DataFrame:
    """A row for each thread of link_rows: conv_id, root_turn, messages, greatest depth, place of its root. Roots of one turn count as one thread."""
    return linked.where("position IS NOT NULL").groupBy("conv_id", "root_turn").agg(F.count("*").alias("n_messages"), F.max("depth").alias("max_depth"), F.min("position").alias("position"))
