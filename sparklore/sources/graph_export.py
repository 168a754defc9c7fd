"""Graph exports as text lines: JSON, GraphML, Cypher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# GraphML frame.
GRAPHML_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    '<key id="name" for="node" attr.name="name" attr.type="string"/>',
    '<key id="type" for="node" attr.name="type" attr.type="string"/>',
    '<key id="rel" for="edge" attr.name="relation" attr.type="string"/>',
    '<graph edgedefault="directed">',
]
GRAPHML_TAIL = ["</graph>", "</graphml>"]


def _chain(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_text(c) -> Column:
    return _chain(F.coalesce(F.col(c), F.lit("")), [("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")])


def xml_attr(c) -> Column:
    """A quoted attribute; line breaks and tabs as references, the quote that needs no escape."""
    x = _chain(xml_text(c), [("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")])
    both = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(x.contains('"') & ~x.contains("'"), F.concat(F.lit("'"), x, F.lit("'"))).otherwise(both)


def number_rows(df: DataFrame, id_col: str, name: str = "row_no", prefix: int = 3) -> DataFrame:
    """Consecutive numbers from 0 in a fixed order without sorting all rows in one task.

    Rows fall into 16**prefix buckets by the hash of their id; bucket sizes give each bucket
    its first number (a window over the bucket table only), a window per bucket the rest.
    """
    hashed = df.withColumn("_b", F.substring(F.sha2(F.col(id_col), 256), 1, prefix))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_b").orderBy(id_col)
    return (hashed.join(F.broadcast(first), "_b")  # at most 16**prefix rows
            .withColumn(name, F.col("_first") + F.row_number().over(inside) - 1).drop("_b", "_first"))


def json_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = entities.select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"),
                            F.to_json(F.struct("entity_id", "name", "type")).alias("line"))
    links = edges.select(F.lit("edge").alias("kind"), F.col("relation_id").alias("id"), F.to_json(F.struct(
        F.col("source_entity").alias("source"), F.col("relation_type").alias("relation"),
        F.col("target_entity").alias("target"))).alias("line"))
    return nodes.unionByName(links)


def graphml_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines with a part and a key to sort by: head, nodes, edges, tail."""
    spark = entities.sparkSession
    frame = spark.createDataFrame(
        [(0, f"{i:02d}", line) for i, line in enumerate(GRAPHML_HEAD)]
        + [(3, f"{i:02d}", line) for i, line in enumerate(GRAPHML_TAIL)], "part int, key string, line string")
    nodes = entities.select(F.lit(1).alias("part"), F.col("entity_id").alias("key"), F.concat(
        F.lit("<node id="), xml_attr("entity_id"), F.lit('><data key="name">'), xml_text("name"),
        F.lit('</data><data key="type">'), xml_text("type"), F.lit("</data></node>")).alias("line"))
    numbered = number_rows(edges, "relation_id")
    links = numbered.select(F.lit(2).alias("part"), F.format_string("%019d", F.col("row_no")).alias("key"), F.concat(
        F.lit('<edge id="e'), F.col("row_no").cast("string"), F.lit('" source='), xml_attr("source_entity"),
        F.lit(" target="), xml_attr("target_entity"), F.lit('><data key="rel">'), xml_text("relation_type"),
        F.lit("</data></edge>")).alias("line"))
    return frame.unionByName(nodes).unionByName(links)


def cypher_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    def quoted(c):
        return F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("'"), F.lit("\\'"))
    nodes = entities.select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"), F.concat(
        F.lit("MERGE (e:Entity {id:'"), "entity_id", F.lit("'}) SET e.name='"), quoted("name"),
        F.lit("', e.type='"), quoted("type"), F.lit("';")).alias("line"))
    label = F.regexp_replace(F.upper(F.coalesce("relation_type", F.lit("REL"))), r"(?U)[^\p{Alnum}_]", "")
    links = edges.select(F.lit("edge").alias("kind"), F.col("relation_id").alias("id"), F.concat(
        F.lit("MATCH (a:Entity {id:'"), "source_entity", F.lit("'}),(b:Entity {id:'"), "target_entity",
        F.lit("'}) MERGE (a)-[:"), F.when(label == "", "REL").otherwise(label), F.lit("]->(b);")).alias("line"))
    return nodes.unionByName(links)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text files whose names keep the global order (range partitions, sorted inside)."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
