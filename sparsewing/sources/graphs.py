"""Circuits from released wiring graphs: neuron tables and connection tables of several layouts to one wiring.

A layout says how a release names its columns and which neurons are inputs (with the type that names their dimension) and
cells. Files are read by Spark (delimited text, or Arrow files through ``arrays``), and the wiring is joins and sums: connections
whose ends are an input with a dimension and a cell, multiplicities added up, entries per dimension and cell with
the number of different inputs. A neuron listed twice counts once; where its rows disagree, the first in order decides.
An empty selection of inputs or cells is an error, as a wiring without either says nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewing.functions import vectors
from sparsewing.operators import wiring

# Names, types and spellings of the releases.
#: Dimensions that are no inputs of smell, and inputs without a dimension of their own.
OTHER_SENSES = "^(VP|MZ)"
UNASSIGNED = ("Z",)
#: Older names of dimensions in one release.
RENAMED = {"VC3l": "VC3", "VC3m": "VC5", "VC5": "VM6"}
INPUT_TYPE = "^[A-Z][A-Za-z0-9+]*_[a-z0-9]*PN"


@dataclass(frozen=True)
class Layout:
    """Columns of the neuron table (id, type, and those that tell the class and the side) and of the connections (pre, post, weight);
    values of class and side; ``format`` and ``options`` of the two readers."""

    neurons: dict[str, str]
    connections: dict[str, str]
    inputs: Column | None = None
    cells: Column | None = None
    sides: dict[str, str] = field(default_factory=dict)
    renamed: dict[str, str] = field(default_factory=dict)
    formats: tuple[str, str] = ("csv", "csv")
    separator: str = ","

    def side(self, side: str) -> Column:
        if side not in self.sides:
            raise ValueError(f"this release has no side {side}")
        return F.lit(True) if not self.sides[side] else F.col("side") == self.sides[side]


def _typed() -> Layout:
    """Types alone tell the neurons; one side only."""
    inputs = F.col("type").rlike(INPUT_TYPE) & ~F.coalesce(F.col("instance"), F.lit("")).endswith("_L")
    return Layout({"id": "bodyId", "type": "type", "instance": "instance"}, {"pre": "bodyId_pre", "post": "bodyId_post", "weight": "weight"}, inputs, F.col("type").startswith("KC"), {"R": ""}, RENAMED)


def _classed(neurons: dict, connections: dict, input_class: str, cell_class: str, sides: dict, formats: tuple[str, str], separator: str = ",") -> Layout:
    return Layout(neurons, connections, F.col("class") == input_class, F.col("class") == cell_class, sides, {}, formats, separator)


def layouts() -> dict[str, Layout]:
    """The layouts by name (a session must be there, as they hold expressions)."""
    both = {"R": "right", "L": "left"}
    return {
        "typed_csv": _typed(),
        "classed_tsv": _classed({"id": "root_id", "type": "cell_type", "class": "cell_class", "side": "side"}, {"pre": "pre_pt_root_id", "post": "post_pt_root_id", "weight": "syn_count"}, "ALPN", "Kenyon_Cell", both, ("csv", "arrow_batches"), "\t"),
        "classed_arrow": _classed({"id": "banc_888_id", "type": "cell_type", "class": "cell_class", "side": "side"}, {"pre": "pre", "post": "post", "weight": "count"}, "antennal_lobe_projection_neuron", "kenyon_cell", both, ("arrow_batches", "arrow_batches")),
        "bodies_arrow": _classed({"id": "bodyId", "type": "type", "class": "class", "side": "somaSide"}, {"pre": "body_pre", "post": "body_post", "weight": "weight"}, "ALPN", "Kenyon_Cell", {"R": "R", "L": "L"}, ("arrow_batches", "arrow_batches")),
    }


def _read(spark: SparkSession, path: str, kind: str, columns: dict[str, str], types: dict[str, str], separator: str) -> DataFrame:
    if kind == "csv":
        df = spark.read.csv(path, header=True, sep=separator)
        if missing := set(columns.values()) - set(df.columns):
            raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    else:
        df = spark.read.format(kind).schema(", ".join(f"`{c}` {types[n]}" for n, c in columns.items())).load(path)
    return df.select(*[F.col(f"`{c}`").cast(types[n]).alias(n) for n, c in columns.items()])


def neurons(spark: SparkSession, layout: Layout, path: str) -> DataFrame:
    """(id, type, ...) of a release, a row for each neuron."""
    rows = _read(spark, path, layout.formats[0], layout.neurons, {n: "long" if n == "id" else "string" for n in layout.neurons}, layout.separator).filter("id is not null")
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*others)).alias("x")).select("id", "x.*")


def connections(spark: SparkSession, layout: Layout, path: str) -> DataFrame:
    """(pre, post, weight) of a release, multiplicities not yet added up."""
    c = _read(spark, path, layout.formats[1], layout.connections, {"pre": "long", "post": "long", "weight": "long"}, layout.separator)
    return c.filter("pre is not null and post is not null and weight is not null")


def inputs(rows: DataFrame, layout: Layout, side: str, smell_only: bool = True) -> DataFrame:
    """(pre, dim): the inputs of a side and the name of their dimension; those without one are left out."""
    dim = vectors.type_to_dim(F.col("type"))
    for old, new in layout.renamed.items():  # each name is looked up once: a new name may be another's old one
        dim = F.when(vectors.type_to_dim(F.col("type")) == old, new).otherwise(dim)
    x = rows.filter(layout.inputs & layout.side(side)).select(F.col("id").alias("pre"), dim.alias("dim")).filter(F.col("dim").isNotNull() & ~F.col("dim").isin(list(UNASSIGNED)))
    return x.filter(~F.col("dim").rlike(OTHER_SENSES)) if smell_only else x


def circuit(spark: SparkSession, name: str, neurons_path: str, connections_path: str, side: str = "R", threshold: int = 1, smell_only: bool = True) -> DataFrame:
    """(dim, cell, w, partners): the wiring of one side of a release in the layout ``name``, entries from ``threshold`` on."""
    layout = layouts()[name]
    rows = neurons(spark, layout, neurons_path)
    pre = inputs(rows, layout, side, smell_only)
    post = rows.filter(layout.cells & layout.side(side)).select(F.col("id").alias("post"))
    if pre.isEmpty() or post.isEmpty():
        raise ValueError(f"no inputs or no cells on side {side}")
    return wiring.build(wiring.no_loops(connections(spark, layout, connections_path)).join(post, "post", "left_semi"), pre, threshold)
