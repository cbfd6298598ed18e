"""Flow records to features.

Every code column is a count of half steps, so a flow's codes become one list of column names, each name
worth one step (a code the server chose appears twice, and so on). That list feeds all layouts: a sparse
vector by vocabulary lookup, the wide table, and the long form.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope import schema as S
from flowscope.functions.codes import in_ranges, parse_code_list, parse_until_error

STEP = 0.5  # fixed value: what one occurrence weighs
STEPS = "code_steps"
#: Rows that a task should widen, and into how many parts at most they go if there are idle cores.
WIDE_ROWS, CORE_TASKS = 50_000, 10


def _known(codes: Column, ranges) -> Column:
    return F.filter(codes, lambda c: in_ranges(c, ranges))


def _twice(codes: Column, chosen: Column) -> Column:
    """The codes with each occurrence of the chosen one repeated."""
    return F.concat(codes, F.filter(codes, lambda c: c == chosen))


def _repeat(name: str, times: Column) -> Column:
    return F.array_repeat(F.lit(name), times.cast("int"))


def _hex_name(prefix: str):
    """Name of a vocabulary code, all of which have at most four hex digits."""
    return lambda c: F.concat(F.lit(prefix), F.lower(F.lpad(F.hex(c), 4, "0")))


def _decimal_name(prefix: str):
    return lambda c: F.concat(F.when(c < 10, prefix + "0").otherwise(prefix), c.cast("string"))


def _others(codes: Column, known: Column, chosen: Column | None, ranges) -> Column:
    """Number of codes outside the vocabulary, those the server chose counted twice."""
    count = F.size(codes) - F.size(known)
    if chosen is None:
        return count
    bonus = F.when(~in_ranges(chosen, ranges), F.size(F.filter(codes, lambda c: c == chosen)))
    return count + F.coalesce(bonus, F.lit(0))


def cipher_steps(codes: Column, known: Column, chosen: Column, bonus_for_unknown: bool = True) -> Column:
    """One step per occurrence, one more where it is the server's choice; unknown codes share ``cs_unknown``."""
    names = F.transform(_twice(known, chosen), _hex_name("cs_"))
    others = _others(codes, known, chosen if bonus_for_unknown else None, S.CIPHER_RANGES)
    return F.concat(names, _repeat("cs_unknown", others))


def signature_steps(codes: Column, known: Column) -> Column:
    """One step per known code; 0 or no code at all is ``sig_empty``; n reserved codes weigh 1 + (n-1)/2."""
    reserved = F.size(codes) - F.size(known) - F.size(F.filter(codes, lambda c: c == 0))
    empty = (F.size(codes) == 0) | F.array_contains(codes, 0)
    return F.concat(
        F.transform(F.array_distinct(known), _hex_name("sig_")),
        _repeat("sig_empty", F.when(empty, 1).otherwise(0)),
        _repeat("sig_grease", F.when(reserved > 0, reserved + 1).otherwise(0)),
    )


def group_steps(codes: Column, known: Column, chosen: Column) -> Column:
    """One step per known code, two for the server's choice; unknown ones add up in ``grp_grease``."""
    names = F.transform(_twice(F.array_distinct(known), chosen), _decimal_name("grp_"))
    return F.concat(names, _repeat("grp_grease", _others(codes, known, chosen, S.GROUP_RANGES)))


def point_steps(known: Column) -> Column:
    return F.transform(F.array_distinct(known), _decimal_name("pts_"))


def extension_steps(codes: Column, known: Column) -> Column:
    """One step per known code; unknown ones add up in ``svr_ext_unassigned``."""
    names = F.transform(F.array_distinct(known), _decimal_name("svr_ext_"))
    return F.concat(names, _repeat("svr_ext_unassigned", _others(codes, known, None, S.EXTENSION_RANGES)))


# --- scalars ---------------------------------------------------------------------------------------
def client_scalars() -> list[Column]:
    return [F.col(field).try_cast("double").alias(name) for name, field in S.CLIENT_SCALARS.items()]


def server_versions(prefix: str = "srv_") -> list[Column]:
    return [
        F.col(prefix + "Version").try_cast("double").alias("svr_tls_ver"),
        F.col(prefix + "SupportedVersion").try_cast("double").alias("svr_supported_ver"),
    ]


def ocsp_flag(prefix: str = "srv_") -> Column:
    """``'false'`` gives 0, anything else 1."""
    return F.when(F.col(prefix + "OCSPStapling") == "false", 0.0).otherwise(1.0).alias("svr_ocsp_staple")


SCALAR_COLUMNS = [*S.OSINT_COLUMNS, *S.CLIENT_SCALARS, *S.SERVER_SCALARS]


# --- flows to steps --------------------------------------------------------------------------------
CIPHER, SIGNATURE, GROUP, POINT, EXTENSION = "cipher", "signature", "group", "point", "extension"
FAMILIES = [CIPHER, SIGNATURE, GROUP, POINT, EXTENSION]
CODE_TEXT = {
    CIPHER: "CipherSuites",
    SIGNATURE: "SignatureAlgs",
    GROUP: "SupportedGroups",
    POINT: "SupportedPoints",
    EXTENSION: "srv_Extensions",
}


VOCABULARY = {
    CIPHER: S.CIPHER_RANGES,
    SIGNATURE: S.SIGNATURE_MATCHED_RANGES,
    GROUP: S.GROUP_RANGES,
    POINT: S.POINT_RANGES,
    EXTENSION: S.EXTENSION_RANGES,
}


def _steps(flows: DataFrame, codes: dict[str, Column], bonus_for_unknown: bool) -> DataFrame:
    """Code lists to ``code_steps``. Lists and their known part get projections of their own, so each is
    worked out once."""
    flows = flows.withColumns({f"_{name}": column for name, column in codes.items()})
    flows = flows.withColumns({f"_{name}_known": _known(F.col(f"_{name}"), VOCABULARY[name]) for name in codes})
    chosen_cipher = F.col("srv_CipherSuite").try_cast("int")
    chosen_group = F.col("srv_SelectedGroup").try_cast("int")
    make = {
        CIPHER: lambda c, k: cipher_steps(c, k, chosen_cipher, bonus_for_unknown),
        SIGNATURE: signature_steps,
        GROUP: lambda c, k: group_steps(c, k, chosen_group),
        POINT: lambda c, k: point_steps(k),
        EXTENSION: extension_steps,
    }
    parts = [make[name](F.col(f"_{name}"), F.col(f"_{name}_known")) for name in codes]
    dropped = [column for name in codes for column in (f"_{name}", f"_{name}_known")]
    return flows.withColumn(STEPS, F.concat(*parts)).drop(*dropped)


def weigh_codes(flows: DataFrame, families: list[str] = FAMILIES) -> DataFrame:
    """Add ``code_steps``; every family stands on its own, unreadable tokens are left out."""
    return _steps(flows, {name: parse_code_list(F.col(CODE_TEXT[name])) for name in families}, True)


def weigh_codes_stop_at_error(flows: DataFrame) -> DataFrame:
    """The compatible form: families are read in order and the first error leaves the rest at 0.

    Errors are an unreadable token, a blank list (but for signatures), and a server cipher that is outside
    the vocabulary yet offered. A point format outside the vocabulary loses the whole row. A bare server
    extension loses its first character.
    """
    none = F.array().cast("array<int>")
    offered, readable = parse_until_error(F.col("CipherSuites"))
    flows = flows.withColumns({"_offered": offered, "_readable": readable})
    chosen = F.col("srv_CipherSuite").try_cast("int")
    foreign = F.coalesce(~in_ranges(chosen, S.CIPHER_RANGES) & F.array_contains("_offered", chosen), F.lit(False))
    until_foreign = F.slice("_offered", F.lit(1), F.array_position("_offered", chosen).cast("int"))
    blank = F.col("SignatureAlgs").rlike(r"^(\(?\)?|\(-.*\))$")
    extensions = F.col("srv_Extensions")
    listed = F.when(extensions.startswith("("), extensions).otherwise(F.substring(extensions, F.lit(2), F.length(extensions)))
    sig, sig_ok = parse_until_error(F.when(blank, F.lit("0")).otherwise(F.col("SignatureAlgs")))
    grp, grp_ok = parse_until_error(F.col("SupportedGroups"))
    pts, pts_ok = parse_until_error(F.col("SupportedPoints"))
    ext, _ = parse_until_error(listed)
    flows = flows.withColumns(
        {
            "_ok1": F.col("_readable") & ~foreign,
            "_offered": F.when(foreign, until_foreign).otherwise(F.col("_offered")),
            "_s": sig,
            "_g": grp,
            "_p": pts,
            "_e": ext,
            "_ok2": sig_ok,
            "_ok3": grp_ok,
            "_ok4": pts_ok,
        }
    )
    reached = [reduce(lambda a, b: a & b, [F.col(f"_ok{j}") for j in range(1, i + 1)]) for i in range(1, 5)]
    codes = {CIPHER: F.col("_offered")}
    for name, column, ok in zip(FAMILIES[1:], ["_s", "_g", "_p", "_e"], reached):
        codes[name] = F.when(ok, F.col(column)).otherwise(none)
    lost = F.exists(codes[POINT], lambda c: ~in_ranges(c, S.POINT_RANGES))
    weighed = _steps(flows.where(~lost), codes, False)
    # an unreached signature list is no empty list
    steps = F.when(F.col("_ok1"), F.col(STEPS)).otherwise(F.array_remove(STEPS, "sig_empty"))
    return weighed.withColumn(STEPS, steps).drop("_offered", "_readable", "_s", "_g", "_p", "_e", *[f"_ok{i}" for i in range(1, 5)])


def with_scalars(flows: DataFrame, label: int | Column = 0) -> DataFrame:
    """Client and server scalars and the label column next to the code steps."""
    label = label if isinstance(label, Column) else F.lit(label)
    rest = [c for c in flows.columns if c != S.LABEL]
    return flows.select(*rest, *client_scalars(), *server_versions(), ocsp_flag(), label.cast("int").alias(S.LABEL))


# --- layouts ---------------------------------------------------------------------------------------
def _filled(name: str, have: set[str]) -> str:
    kind = "int" if name == S.LABEL else "double"
    return f"coalesce(cast(`{name}` as {kind}), cast(0 as {kind})) as `{name}`" if name in have else f"cast(0 as {kind}) as `{name}`"


def align_zero_fill(df: DataFrame, columns: list[str] = S.FEATURE_COLUMNS, keep: list[str] = ()) -> DataFrame:
    """Every column of the layout, in order, 0 where it is missing or null."""
    have = set(df.columns)
    return df.selectExpr(*keep, *[_filled(c, have) for c in columns])


def code_counts(weighed: DataFrame, name: str = "code_counts") -> DataFrame:
    """Sparse vector of step counts over the code columns."""
    counter = CountVectorizerModel.from_vocabulary(S.CODE_COLUMNS, inputCol=STEPS, outputCol=name, minTF=1.0)
    return counter.transform(weighed)


def dealt(weighed: DataFrame, row_id: str = "flow_id", rows: int = WIDE_ROWS) -> DataFrame:
    """The narrow rows dealt by a hash of their id into tasks of ``rows`` at most, on average, for a wide table to be written: narrow
    rows lie in few large splits, while each becomes 519 cells, which is what the time goes into. Fewer rows go to all cores."""
    n, cores = weighed.count(), weighed.sparkSession.sparkContext.defaultParallelism
    return weighed.repartition(max(1, math.ceil(n / rows), min(cores, n * CORE_TASKS // rows)), row_id)


def encode_wide(weighed: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The fixed wide table. Keep this the last step: the projection is too wide for fused code."""
    counted = code_counts(weighed).withColumn("_codes", vector_to_array("code_counts"))
    have = set(weighed.columns)
    place = {name: i for i, name in enumerate(S.CODE_COLUMNS)}
    columns = [f"_codes[{place[c]}] * {STEP}D as `{c}`" if c in place else _filled(c, have) for c in S.FEATURE_COLUMNS]
    return counted.selectExpr(*keep, *columns)


VECTOR_COLUMNS = [*SCALAR_COLUMNS, *S.CODE_COLUMNS]


def encode_vector(weighed: DataFrame, keep: list[str] = (), name: str = "features") -> DataFrame:
    """One sparse vector over ``VECTOR_COLUMNS``, for jobs that need no named columns."""
    have = set(weighed.columns)
    scalars = code_counts(weighed).selectExpr(*keep, "code_counts", *[_filled(c, have) for c in SCALAR_COLUMNS])
    halves = ElementwiseProduct(
        scalingVec=Vectors.dense([STEP] * len(S.CODE_COLUMNS)), inputCol="code_counts", outputCol="_codes"
    )
    assembler = VectorAssembler(inputCols=[*SCALAR_COLUMNS, "_codes"], outputCol=name)
    return assembler.transform(halves.transform(scalars)).select(*keep, name)


def encode_sparse(weighed: DataFrame, keep: list[str]) -> DataFrame:
    """Long form ``(*keep, feature, value)`` of the non-zero features, without building the wide row."""
    cell = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    steps = F.col(STEPS)
    codes = F.transform(
        F.array_distinct(steps), lambda n: cell(n, STEP * (F.size(steps) - F.size(F.array_remove(steps, n))))
    )
    scalars = [c for c in weighed.columns if c in SCALAR_COLUMNS]
    cells = codes
    if scalars:
        single = F.array(*[cell(F.lit(c), F.coalesce(F.col(c), F.lit(0.0))) for c in scalars])
        cells = F.concat(F.filter(single, lambda e: e["value"] != 0), codes)
    return weighed.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.feature", "cell.value")


def code_sums(weighed: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sum of each code column per group: a count of names, combined map-side."""
    named = weighed.select(*by, F.explode(STEPS).alias("feature"))
    return named.groupBy(*by, "feature").agg((F.count("*") * STEP).alias("total"))
