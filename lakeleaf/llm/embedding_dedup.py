"""Near-duplicate vectors by product quantisation (operator 9).

A coarse quantiser deals the unit vectors of a label to inverted lists; what a list's centre leaves of a vector is coded by subspaces, once, and only codes
go to the lists. A vector probes the lists whose border with its own is near: a link of length `radius` in no special direction reaches REACH standard deviations
of its part along the line between two centres, or all of it in few dimensions. In a list, table look-ups give the distance to each coded vector, less the coding
errors of both a lower bound; the vectors themselves are fetched only for what is left and compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _kind
from .components import components, spanning
from .runtime import cut, written
from .vectors import usable

THRESHOLD = 0.93
#: Vectors the quantisers are fitted on at most (those of the smallest hashes); every vector is coded and compared.
TRAIN_ROWS = 20_000
#: Vectors of the sample that the codebooks are fitted on at most.
BOOK_ROWS = 8_192
#: A list for so many vectors of a label: lists grow in number with the table, up to one for TRAINED_A_LIST vectors of the label's sample.
ROWS_A_LIST = 512
TRAINED_A_LIST = 8
#: Components of a subspace, at least; subspaces, at most; codes of each.
SUBSPACE, MOST_SUBSPACES, CODES = 4, 16, 256
#: Standard deviations of a random link's part along a line that a probe allows for. In WIDTH <= REACH ** 2 components every link is allowed for.
REACH = 4.0
#: Vectors of a list that a task compares at once: a larger list is dealt out in such blocks, and its probes are copied to each.
BLOCK = 2_048
_SLACK = 1e-6
#: What a row is in a list: one of its vectors, one of them looking for others, or one of an earlier list looking.
MEMBER, OWN, FOREIGN = 0, 1, 2


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k centres of the rows of x (all rows, if fewer)."""
    if len(x) <= k:
        return x.copy()
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1. A power of two is taken out first, so that no square is too large or too small."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    scaled = np.ldexp(vectors, -power[:, None])
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


class Index:
    """Centres of the lists of each label, and the codebooks of the subspaces of what is left."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, growth: float = 1.0):
        """x: unit vectors of a sample, each standing for `growth` of the table."""
        self.width = x.shape[1]
        parts = min(MOST_SUBSPACES, max(1, self.width // SUBSPACE))
        self.cuts = np.linspace(0, self.width, parts + 1).astype(int)
        self.labels: dict[object, tuple[int, np.ndarray]] = {}
        residual, first = [], 0
        for name in sorted(set(labels.tolist())):
            own = x[labels == name]
            lists = max(1, min(int(len(own) * growth) // ROWS_A_LIST, len(own) // TRAINED_A_LIST))
            centres = k_means(own, lists)
            self.labels[name] = (first, centres)
            first += len(centres)
            residual.append(own - centres[_nearest(own, centres)])
        left = np.concatenate(residual) if residual else np.zeros((1, self.width))
        left = left[:: -(-len(left) // BOOK_ROWS)]
        self.books = [k_means(left[:, a:b], CODES) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def centres(self, label: object) -> tuple[int, np.ndarray]:
        """The number of a label's first list and its centres; a label that the sample lacks has one list around zero."""
        return self.labels.get(label, (0, np.zeros((1, self.width))))

    def probes(self, x: np.ndarray, label: object, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own list of each vector, and pairs (vector, list) of the own list and all later ones that can hold a vector within the radius of it.

        Both vectors of a link see that the other's list can hold it, so it is enough that the one of the earlier list looks."""
        first, centres = self.centres(label)
        squares = np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0)
        own = squares.argmin(1)
        met, place = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum((centres[met] ** 2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres[met] @ centres.T, 0))[place]
        # A vector that belongs to another cell lies beyond the plane between the two centres.
        along = radius * min(1.0, REACH / np.sqrt(self.width))
        reach = (squares - squares[np.arange(len(x)), own][:, None]) <= 2 * apart * (along + _SLACK) + _SLACK
        reach &= np.arange(len(centres)) > own[:, None]
        reach[np.arange(len(x)), own] = True
        rows, lists = np.nonzero(reach)
        return own + first, rows, lists + first

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by subspace, and each vector's distance from what its codes stand for."""
        codes, error = np.empty((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for i, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            part = residual[:, a:b]
            codes[:, i] = _nearest(part, book)
            error += ((part - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What codes stand for."""
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of each row of residual to what each row of codes stands for, by a table of each subspace."""
        out = np.zeros((len(residual), len(codes)), np.float32)
        for i, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            part = residual[:, a:b]
            table = np.maximum((part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T, 0).astype(np.float32)
            out += table[:, codes[:, i]]
        return np.sqrt(out, out=out)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: the id, n_links bigint, component_id, kept boolean (the row is its component's id).

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is threshold or more. n_links counts the other rows
    linked directly, component_id is the smallest id reached by links. A vector that is null or empty or zero or has a null or non-finite component
    links with nothing, as does a row without id; vectors of different lengths don't link with each other. Repeated rows of a label and vector are one class: it is compared once, and each
    of its rows links with the others. Lists of any size are compared in blocks; of a pair of blocks only counts and spanning links are kept.
    No rows give no rows."""
    spark, kind = df.sparkSession, _kind(df, id_col)
    radius = float(np.sqrt(2 - 2 * threshold))
    number = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # floats are moved as such, and compared as doubles
    fit = usable(vector_col) & F.exists(F.col(vector_col), lambda v: v != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    read = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(fit, F.col(vector_col).cast(f"array<{number}>")).alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = written(read, "vectors")
    good = rows.where("vector IS NOT NULL")
    digest = [F.xxhash64(F.lit(i), "vector").alias(f"digest{i}") for i in (0, 1)]
    same = ["label", "digest0", "digest1"]
    classes = good.select("id", "row", "label", *digest).groupBy(*same).agg(F.min("row").alias("class"), F.min("id").cast("bigint").alias("least"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    total = classes.count()
    index = spark.sparkContext.broadcast(_fitted(good, classes, total))

    def of_width(width: int) -> Index:
        """The index of the vectors of a length; one that the sample lacks has one list a label, around zero."""
        if width not in index.value:
            index.value[width] = Index(np.zeros((0, width)), np.zeros(0, object))
        return index.value[width]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's list, the lists that it probes, its code and the code's error."""
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = np.array(batch.column(1).to_pylist(), object)
            widths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for width, label in sorted(set(zip(widths.tolist(), labels.tolist(), strict=True))):
                at = np.flatnonzero((widths == width) & (labels == label))
                x = units(batch.column(2).take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), width))
                own_index = of_width(width)
                first, centres = own_index.centres(label)
                own, found, lists = own_index.probes(x, label, radius)
                codes, error = own_index.encode(x - centres[own - first])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(found, minlength=len(at))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        batch.column(1).take(pa.array(at)),
                        pa.array(np.full(len(at), width, np.int32)),
                        pa.array(own.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.astype(np.int32))),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(error.astype(np.float32)),
                    ],
                    ["row", "label", "width", "own", "probes", "code", "error"],
                )

    label_kind = df.schema[label_col].dataType.simpleString()
    coded = good.select("row", "label", "vector").mapInArrow(code, f"row bigint, label {label_kind}, width int, own int, probes array<int>, code binary, error float")
    coded = written(coded, "codes").join(classes.select(F.col("class").alias("row"), "copies"), "row")  # of equal vectors only one goes on
    role = F.when(F.col("list") == F.col("own"), OWN).otherwise(FOREIGN)
    seekers = coded.select("label", "width", F.explode("probes").alias("list"), "own", F.col("row").alias("class"), "copies", "code", "error").withColumn("probe", role)
    members = coded.select("label", "width", F.col("own").alias("list"), "own", F.col("row").alias("class"), "copies", "code", "error", F.lit(MEMBER).alias("probe"))
    place = ["label", "width", "list"]
    sizes = coded.groupBy("label", "width", F.col("own").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("member_blocks"))
    sought = coded.select("label", "width", F.explode("probes").alias("list")).groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("seeker_blocks"))
    blocks = cut(sizes.join(sought, place))
    # Blocks of a list: members in member_blocks parts, probes in seeker_blocks; a row goes to every block of the other side.
    member = F.col("probe") == MEMBER
    part = F.pmod(F.xxhash64("class"), F.when(member, F.col("member_blocks")).otherwise(F.col("seeker_blocks"))).cast("int")
    others = F.when(member, F.col("seeker_blocks")).otherwise(F.col("member_blocks"))
    spread = members.union(seekers.select(*members.columns)).join(blocks, place).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    task = F.xxhash64(*place, F.when(member, F.col("part")).otherwise(F.col("other")), F.when(member, F.col("other")).otherwise(F.col("part"))).alias("task")
    packed = spread.groupBy(*place, task).agg(F.collect_list(F.struct("probe", "class", "own", "code", "error", "copies")).alias("all"))
    packed = packed.select(*place, "task", *(F.col(f"all.{c}").alias(c) for c in ("probe", "class", "own", "code", "error", "copies")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What of a pair of blocks has a partner within the radius, as far as the codes tell."""
        names = [*place, "task", "probe", "class", "copies"]
        for batch in batches:
            for i in range(batch.num_rows):
                label, width, number_of = (batch.column(j)[i].as_py() for j in range(3))
                probe, classes_, own, code_, error, copies = (batch.column(j)[i].values for j in range(4, 10))
                probe, classes_, own, error, copies = (x.to_numpy(zero_copy_only=False) for x in (probe, classes_, own, error, copies))
                model = of_width(width)
                first, centres = model.centres(label)
                codes = np.frombuffer(b"".join(code_.to_pylist()), np.uint8).reshape(len(probe), -1)
                keep = np.flatnonzero(_sifted(model, centres[number_of - first], centres[own - first], codes, error, probe, classes_, radius))
                if len(keep):
                    same_task = [batch.column(j).take(pa.array(np.full(len(keep), i))) for j in range(4)]
                    yield pa.RecordBatch.from_arrays([*same_task, *(pa.array(x[keep]) for x in (probe, classes_, copies))], names)

    near = written(packed.mapInArrow(sift, f"label {label_kind}, width int, list int, task bigint, probe int, class bigint, copies bigint"), "near")
    wanted = good.join(near.select(F.col("class").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("class"), "vector")
    groups = near.join(wanted, "class").groupBy(*place, "task").agg(F.collect_list(F.struct("probe", "class", "copies", "vector")).alias("all"))
    groups = groups.select(F.col("all.probe").alias("probe"), F.col("all.class").alias("class"), F.col("all.copies").alias("copies"), F.flatten("all.vector").alias("values"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                probe, classes_, copies, values = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(4))
                found = _compared(values.astype(np.float64).reshape(len(probe), -1), probe, classes_, copies, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["class", "links", "root"])

    found = written(groups.mapInArrow(compare, "class bigint, links bigint, root bigint"), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    reach = components(found.where("root <> class").select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "class", "left").join(reach.withColumnRenamed("node", "class"), "class", "left")
    named = cut(named.select(*same, "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component")))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(lowest, "component").select(*(F.col(c).alias(f"of_{c}") for c in same), "n_links", "component_id")
    whole = rows.select("id", "label", *(F.when(F.col("vector").isNotNull(), d).alias(f"digest{i}") for i, d in enumerate(digest)))
    joined = whole.join(answer, [F.col(c) == F.col(f"of_{c}") for c in same], "left")
    component = F.coalesce(F.col("component_id").cast(kind), F.col("id"))
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")
    )


def _fitted(good: DataFrame, classes: DataFrame, total: int) -> dict[int, Index]:
    """For each length of vectors an index, of a sample of TRAIN_ROWS classes at most (those of the smallest hashes)."""
    turn = F.pmod(F.xxhash64("class"), F.lit(1_000_000_000))
    share = 1_000_000_000 if total <= TRAIN_ROWS else int(1_200_000_000 * TRAIN_ROWS / total) + 1
    chosen = classes.where(turn < share).select(F.col("class").alias("row"), turn.alias("turn")).orderBy("turn", "row").limit(TRAIN_ROWS)
    taken = good.join(F.broadcast(chosen), "row").select("row", "label", "vector").toArrow().sort_by("row")
    widths = pa.compute.list_value_length(taken.column("vector")).to_numpy()
    labels = np.array(taken.column("label").to_pylist(), object)
    found: dict[int, Index] = {}
    for width in sorted(set(widths.tolist())):
        at = np.flatnonzero(widths == width)
        x = taken.column("vector").take(pa.array(at)).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(at), width)
        found[width] = Index(units(x), labels[at], max(1.0, total / max(1, len(taken))))
    return found


def _sifted(index: Index, centre: np.ndarray, centres: np.ndarray, codes: np.ndarray, error: np.ndarray, probe: np.ndarray, classes: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of a block of a list and a block of its probes have a partner on the other side whose distance, less the errors of both codes, is within the radius."""
    member, seeker = np.flatnonzero(probe == MEMBER), np.flatnonzero(probe != MEMBER)
    keep = np.zeros(len(probe), bool)
    if not len(member) or not len(seeker):
        return keep
    there = index.decode(codes[seeker]) + centres[seeker] - centre
    apart = index.distances(there, codes[member])
    apart -= error[member]
    apart -= error[seeker][:, None]
    close = apart <= radius + 1e-3  # the tables are of single precision
    close &= classes[seeker][:, None] != classes[member]
    keep[seeker], keep[member] = close.any(1), close.any(0)
    return keep


def _compared(vectors: np.ndarray, probe: np.ndarray, classes: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of a list and one block of its probes: (class, links, root) for each class with links, copies counted, and the least class that it reaches
    within the block. A link with a probe of an earlier list counts for both ends here, one within the list for the probe: the other end probes too."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    vectors = np.ldexp(vectors, -power[:, None])  # by powers of two, so that no square is too large or too small
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    member, seeker = np.flatnonzero(probe == MEMBER), np.flatnonzero(probe != MEMBER)
    close = (vectors[seeker] @ vectors[member].T) / (norms[seeker][:, None] * norms[member])
    rows, columns = np.nonzero(close >= threshold - 1e-9)
    other = classes[seeker[rows]] != classes[member[columns]]
    rows, columns = rows[other], columns[other]
    # What is about the threshold is summed up in the order of the components.
    edge = np.flatnonzero(close[rows, columns] < threshold + 1e-9)
    a, b = seeker[rows[edge]], member[columns[edge]]
    below = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) < threshold
    rows, columns = np.delete(rows, edge[below]), np.delete(columns, edge[below])
    links = np.zeros(len(vectors), np.int64)
    np.add.at(links, seeker[rows], copies[member[columns]])
    foreign = probe[seeker[rows]] == FOREIGN
    np.add.at(links, member[columns[foreign]], copies[seeker[rows[foreign]]])
    nodes, place = np.unique(classes, return_inverse=True)  # a class can be in both blocks
    root = spanning(len(nodes), iter([(place[seeker[rows]], place[member[columns]])]))
    some = np.flatnonzero((links > 0) | (root[place] != place))
    return classes[some], links[some], nodes[root[place[some]]]
