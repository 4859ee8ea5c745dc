"""JSON of unknown shape: leaves rewritten in place, and every value with its pointer.

Leaves are rewritten by tokens, so depth is no matter and nothing but a string's own text
changes: keys, numbers, order and blanks stay.  Values are walked level by level as variants, a
join with ``variant_explode`` for each level of nesting and a written table between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

# A string with what makes it a key, another string, or what stands between strings.
_TOKENS = r'"(?:[^"\\]|\\.)*+"\s*+:|"(?:[^"\\]|\\.)*+"|[^"]++'

#: What is taken out of artifacts, in this order, and what takes its place.
CLASSES = [
    ("home", r"(?i)[A-Z]:\\Users\\[^\\]+", "<HOME>"),
    ("home", r"(?i)/home/[^/]+", "<HOME>"),
    ("abs", r"(?i)[A-Z]:\\[^\\\n]+", "<ABS_PATH>"),
    ("abs", r"""(?i)/(?:tmp|var/tmp)/[^\s"'<>]+""", "<ABS_PATH>"),
]


def _step(state: Column, regex: str, token: str, at: int, n: int) -> Column:
    hits = F.regexp_count(state["text"], F.lit(regex)).cast("bigint")
    return F.struct(F.regexp_replace(state["text"], F.lit(regex), F.lit(token)).alias("text"), *((state[f"n{i}"] + hits if i == at else state[f"n{i}"]).alias(f"n{i}") for i in range(n)))


def redact_text(text: Column, classes: list[tuple[str, str, str]]) -> Column:
    """A struct of the text with every class replaced in turn, and of the hits n0, n1, ... of each name in order of names."""
    names = list(dict.fromkeys(name for name, _, _ in classes))
    state = F.struct(text.alias("text"), *(F.lit(0).cast("bigint").alias(f"n{i}") for i in range(len(names))))
    for name, regex, token in classes:
        state = F.get(_mapped(state, regex, token, names.index(name), len(names)), 0)
    return state


def _mapped(state: Column, regex: str, token: str, at: int, n: int) -> Column:
    # as a function over an array of one, so that the state's expression is not written out for each of its uses
    return F.transform(F.array(state), lambda s: _step(s, regex, token, at, n))


def redact(docs: DataFrame, column: str, classes: list[tuple[str, str, str]] = CLASSES) -> DataFrame:
    """docs with the string leaves of a JSON column redacted, at any depth, and n_<class> hits of each name.

    What is no JSON is redacted as a text; null stays null, with no hits.
    """
    names = list(dict.fromkeys(name for name, _, _ in classes))
    is_json = F.try_parse_json(F.col(column)).isNotNull()
    whole = F.regexp_extract_all(column, F.lit(_TOKENS), 0)

    def leaf(token: Column) -> Column:
        plain = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
        done = redact_text(plain, classes)
        quoted = F.to_json(F.array(done["text"]))
        return F.struct(F.substr(quoted, F.lit(2), F.length(quoted) - 2).alias("text"), *(done[f"n{i}"].alias(f"n{i}") for i in range(len(names))))

    def kept(token: Column) -> Column:
        return F.struct(token.alias("text"), *(F.lit(0).cast("bigint").alias(f"n{i}") for i in range(len(names))))

    told = F.transform(whole, lambda t: F.when(t.startswith('"') & ~t.endswith(":"), leaf(t)).otherwise(kept(t)))
    parts = F.when(is_json, told).otherwise(F.array(redact_text(F.col(column), classes)))
    rows = docs.withColumn("__parts", F.when(F.col(column).isNotNull(), parts))
    out = rows.withColumn(column, F.array_join(F.transform("__parts", lambda x: x["text"]), ""))
    for i, name in enumerate(names):
        out = out.withColumn(f"n_{name}", F.coalesce(F.aggregate(F.transform("__parts", _field(f"n{i}")), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    return out.drop("__parts")


def _field(name: str):
    return lambda x: x[name]


def walk(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pointer, parent, value): every value below the top with its JSON pointer; parent is array or object, value its text.

    What is no JSON has no rows.  A level of nesting is a written table, so the plan stays as deep as one level.
    """
    level = docs.select(F.col(key).alias("key"), F.lit("").alias("pointer"), F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    found = None
    spark = docs.sparkSession
    while True:
        below = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "child"))
        named = F.coalesce(F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        level = materialize(below.select("key", F.concat("pointer", F.lit("/"), named).alias("pointer"), F.when(F.col("name").isNull(), "array").otherwise("object").alias("parent"), F.col("child").alias("v")), "json-level")
        if level.isEmpty():
            break
        rows = level.select("key", "pointer", "parent", F.col("v").cast("string").alias("value"))
        found = rows if found is None else found.unionByName(rows)
    return docs.sparkSession.createDataFrame([], level.select("key", "pointer", "parent", F.col("v").cast("string").alias("value")).schema) if found is None else found


def dangling(views: DataFrame, known: DataFrame, key: str, column: str, field: str = "evidence") -> DataFrame:
    """(key, pointer, value): items of lists named field, at any depth, whose id (a number, or E and a number) is not in known.id."""
    items = walk(views, key, column).where((F.col("parent") == "array") & F.col("pointer").rlike(f"(^|/){field}/[0-9]+$"))
    number = F.regexp_extract("value", "^E?([0-9]{1,18})$", 1)
    items = items.withColumn("id", F.when(number != "", number.cast("bigint")))
    return items.join(known.select("id"), "id", "left_anti").select("key", "pointer", "value")
