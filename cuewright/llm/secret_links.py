"""Secrets in texts: plain matches, and weak parts of credentials that count only beside their complement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import packed, whole_text
from cuewright.session import written_once


def either_case(word: str) -> str:
    """A pattern for an ASCII word in any case, the same in every regex dialect."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def labelled(labels: list[str], value: str) -> str:
    """``label: value`` or ``label = "value"``; the value is group 2."""
    return f"({'|'.join(map(either_case, labels))})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


#: Kinds in the order of ties; the first three are reported wherever they match, the others only when linked.
#: Name, pattern, least characters of group 2 (0: no such group), what a value must hold.
KINDS = [
    ("assign", labelled(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), 8, ()),
    ("access", "AKIA[A-Z0-9]{12,}", 0, ()),
    ("hex", "[0-9a-f]{32,}", 0, ()),
    ("login", labelled(["user_?name", "user_?id", "user", "login", "client_?id", "account_?id", "access_?key_?id", "key_?id"], "[A-Za-z0-9@._+-]+"), 3, ()),
    ("key", "[A-Za-z0-9+/_=-]{20,}", 0, ("[A-Z]", "[a-z]", "[0-9]")),
    ("endpoint", "[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\x20\\x09-\\x0D\"'<>]{3,}", 0, ()),
]
NAMES = [k[0] for k in KINDS]
BASE = NAMES[:3]
#: What a kind is a part of, and what a weak kind needs beside it.
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "login": "identifier"}
NEEDS = {"login": ["secret"], "key": ["identifier"], "endpoint": ["identifier", "secret"]}
#: Code points around a part that its complement must start in.
REACH = 200

PARTS = "array<struct<kind:int,i:int,gap:int,len:int,keep:boolean>>"
SPANS = "array<struct<start:long,kind_no:int,kind:string,end:long,linked:array<long>>>"


def _matches(text: Column, no: int) -> Column:
    """Every match of a kind: the code points since the match before, its length, and whether its value passes."""
    name, pattern, least, holds = KINDS[no]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found

    def part(z: Column, i: Column) -> Column:
        keep = F.char_length(z["v"]) >= least
        for held in holds:
            keep = keep & z["v"].rlike(held)
        return F.struct(F.lit(no).alias("kind"), i.cast("int").alias("i"), F.char_length(z["g"]).alias("gap"), F.char_length(z["m"]).alias("len"), keep.alias("keep"))

    parts = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v")), lambda z: z["m"].isNotNull())
    made = F.transform(parts, part).cast(PARTS)
    seen = text.contains("://") & text.rlike(pattern) if name == "endpoint" else text.rlike(pattern)
    return F.when(seen, made).otherwise(F.array().cast(PARTS))


def _placed(scanned: DataFrame) -> DataFrame:
    """row_no, kind, start, end of the matches that pass: gaps and lengths summed up along each text's matches of a kind."""
    rows = scanned.select("row_no", F.explode("parts").alias("x")).select("row_no", "x.*")
    along = Window.partitionBy("row_no", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(along))
    return ends.where("keep").select("row_no", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _apart(parts: DataFrame) -> DataFrame:
    """Without the weak parts that overlap a base span, which says more already."""
    here, back = Window.partitionBy("row_no").orderBy("start", "kind"), Window.partitionBy("row_no").orderBy(F.col("start").desc(), F.col("kind").desc())
    base = F.col("kind") < len(BASE)
    covered = F.max(F.when(base, F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, 0)) > F.col("start")
    runs_in = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0)) < F.col("end")
    marked = parts.withColumn("over", F.coalesce(covered, F.lit(False)) | F.coalesce(runs_in, F.lit(False)))
    return marked.where(base | ~F.col("over")).drop("over")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """row_no, kind, start, end, linked: the weak parts with each complement in reach, and where the first found of each starts.

    An interval join: texts are cut into cells of ``reach`` code points. A weak part asks in every cell its scope
    touches; a cell answers with the first and the last start of each role alone. A scope covers its inner cells whole and its outer
    ones from one side, so these two settle the question, and a text full of parts makes no pairs.
    """
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("kind") + 1)
    pick = lambda of, default: F.coalesce(*[F.when(name == k, v) for k, v in of.items()], default)
    none = F.lit(None).cast("string")
    marks = parts.withColumn("role", pick({k: F.lit(v) for k, v in ROLES.items()}, none)).where("role is not null")
    marks = marks.groupBy(F.col("row_no").alias("m_row"), F.floor(F.col("start") / reach).alias("m_cell"), F.col("role").alias("m_role"))
    marks = marks.agg(F.min("start").alias("least"), F.max("start").alias("most"))
    asks = parts.where(F.col("kind") >= len(BASE)).withColumn("needs", pick({k: F.array(*map(F.lit, v)) for k, v in NEEDS.items()}, F.lit(None).cast("array<string>")))
    asks = asks.withColumns({"lo": F.greatest(F.col("start") - reach, F.lit(0)), "hi": F.col("end") + reach})
    asks = asks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor((F.col("hi") - 1) / reach))))
    asks = asks.withColumn("role", F.explode("needs"))
    same = (F.col("row_no") == F.col("m_row")) & (F.col("cell") == F.col("m_cell")) & (F.col("role") == F.col("m_role"))
    met = asks.join(marks, same & (F.col("most") >= F.col("lo")) & (F.col("least") < F.col("hi")))
    met = met.withColumn("at", F.when(F.col("least") >= F.col("lo"), F.col("least")).otherwise(F.col("most")))
    each = met.groupBy("row_no", "kind", "start", "end", "role").agg(F.min("at").alias("at"), F.first(F.size("needs")).alias("wanted"))
    every = each.groupBy("row_no", "kind", "start", "end").agg(F.array_sort(F.collect_list("at")).alias("linked"), F.first("wanted").alias("wanted"))
    return every.where(F.size("linked") == F.col("wanted")).drop("wanted")


def scan(docs: DataFrame, keep: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """The columns ``keep`` and ``spans``, one row per row of ``docs``.

    ``spans`` lists start, kind_no, kind, end (code points, end exclusive) and linked, by start, then kind. Assignments, access
    identifiers and long hex runs are reported alone. Logins, unlabelled keys of mixed characters and addresses are weak: each is
    reported only where the parts it needs (a secret, an identifier, or both) start within ``reach`` code points of it; ``linked`` says where. A
    weak part that overlaps a base span is none. A null text is empty and has no spans; repeated rows are scanned each;
    an empty table gives no rows. Whole texts are read once; only matches are kept, as rows, so a long text full of matches is linear work.
    """
    rows = docs.select(packed(docs.select(*keep)).alias("row"), whole_text(text).alias("whole"))
    parts = F.concat(*[_matches(F.col("whole"), no) for no in range(len(KINDS))])
    # Row numbers lie in the written files, so they stay as they are.
    scanned = written_once(rows.select("row", F.monotonically_increasing_id().alias("row_no"), parts.alias("parts")), "secret-parts")
    found = written_once(_apart(_placed(scanned.where(F.size("parts") > 0))), "secret-places")
    weak = _linked(found, reach)
    spans = found.where(F.col("kind") < len(BASE)).withColumn("linked", F.array().cast("array<long>")).unionByName(weak)
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("kind_no"), name.alias("kind"), "end", "linked")
    spans = spans.groupBy(F.col("row_no").alias("s_row")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = scanned.join(spans, F.col("row_no") == F.col("s_row"), "left")
    return out.select("row.*", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
