import pytest
from pyspark.sql import functions as F

from gridloom.operators import checks, limits, mapping, network
from gridloom.operators.mapping import Rule
from gridloom.sources import results

COLUMNS = "id string, type string, voltage_level string, substation string, connected boolean, in_main_cc boolean, target_p double, min_p double, max_p double, p0 double, fixed_p double, variable_p double"


def equipment(spark, **g):
    base = {"p": 0.0, "lo": 0.0, "hi": 1000.0} | g
    return spark.createDataFrame([("N_G", "GENERATOR", "vl", "s", True, True, base["p"], base["lo"], base["hi"], 0.0, 0.0, 0.0)], COLUMNS)


def corrected(spark, p=None, min_p=None, max_p=None, ignore=False, **g):
    rows = spark.createDataFrame([(1, 0, "N_G", "GENERATOR", p, min_p, max_p, "ts" if p is not None else None, ignore)], "version int, point int, id string, type string, p double, min_p_mapped double, max_p_mapped double, series string, ignore_limits boolean")
    r = limits.correct_limits(limits.with_limits(rows, equipment(spark, **g))).first()
    return r.corrected, r.change, r.violation


@pytest.mark.parametrize(
    "case,expected",
    [
        (dict(p=2000.0), (1000.0, "BASE_CASE_MAXP", None)),
        (dict(p=2000.0, ignore=True), (2000.0, None, "MAXP_BY_TARGETP")),
        (dict(max_p=100.0, **{"hi": 300.0}), (0.0, None, None)),
        (dict(p=200.0, max_p=100.0, hi=300.0), (100.0, "MAPPED_MAXP", None)),
        (dict(p=200.0, max_p=100.0, hi=300.0, ignore=True), (100.0, "MAPPED_MAXP_DISABLED", None)),
        (dict(p=-500.0, lo=-100.0), (-100.0, "BASE_CASE_MINP", None)),
        (dict(p=-500.0, lo=-100.0, ignore=True), (-500.0, None, "MINP_BY_TARGETP")),
        (dict(p=-500.0, lo=-1000.0, min_p=-100.0, ignore=True), (-100.0, "MAPPED_MINP_DISABLED", None)),
        (dict(p=-500.0, lo=100.0), (0.0, "ZERO", None)),
        (dict(p=-500.0, lo=100.0, ignore=True), (0.0, "ZERO_DISABLED", None)),
        (dict(p=50.0, lo=100.0), (50.0, None, "BASE_CASE_MINP_BY_TARGETP")),
        (dict(p=50.0, min_p=100.0), (50.0, None, "MAPPED_MINP_BY_TARGETP")),
        (dict(p=1000.00005), (1000.0 - 1e-4, None, None)),
        (dict(p=0.00005), (1e-4, None, None)),
    ],
)
def test_generator_limits(spark, case, expected):
    assert corrected(spark, **case) == expected


def test_unmapped_power_against_mapped_limits(spark):
    rows = spark.createDataFrame([(1, 0, "N_G", "GENERATOR", None, None, 100.0, None, False)], "version int, point int, id string, type string, p double, min_p_mapped double, max_p_mapped double, series string, ignore_limits boolean")
    r = limits.correct_limits(limits.with_limits(rows, equipment(spark, p=200.0, hi=300.0))).first()
    assert (r.corrected, r.change) == (100.0, "UNMAPPED_TO_MAXP")


@pytest.mark.parametrize("ignore,expected", [(False, (1000.0, 0.0, 1000.0, "TO_MAXP")), (True, (2000.0, 0.0, 2000.0, "MAXP_EXTENDED"))])
def test_base_case(spark, ignore, expected):
    none = spark.createDataFrame([], "id string, variable string")
    r = limits.correct_base_case(equipment(spark, p=2000.0), none, ignore).first()
    assert (r.target_p, r.min_p, r.max_p, r.problem) == expected


def test_limit_extension(spark):
    rows = spark.createDataFrame([(1, k, "N_G", "GENERATOR", p, None, None, "ts", True) for k, p in enumerate([900.0, 2000.0, 1500.0, 2500.0])], "version int, point int, id string, type string, p double, min_p_mapped double, max_p_mapped double, series string, ignore_limits boolean")
    at, final = limits.extend_limits(limits.with_limits(rows, equipment(spark)))
    assert [r.max_limit for r in at.orderBy("point").collect()] == [1000.0, 2001.0, 2000.0, 2501.0]
    assert [(r.side, r.base_limit, r["limit"], r.n_violations) for r in final.collect()] == [("max", 1000.0, 2500.0, 3)]


def test_shares_add_up(spark):
    rows = [(f"g{k}", "GENERATOR", "vl", "s", True, True, 0.0, 0.0, float(k), 0.0, 0.0, 0.0) for k in range(5)]
    gens = spark.createDataFrame(rows, COLUMNS)
    ts = spark.createDataFrame([("ts", 1, 0, 100.0), ("ts", 1, 1, 0.0), ("k", 1, 0, -2.0), ("k", 1, 1, 1.0)], "name string, version int, point int, value double")
    for rule in (Rule("GENERATOR", "ts", key="max_p"), Rule("GENERATOR", "ts"), Rule("GENERATOR", "ts", key=0.0), Rule("GENERATOR", "ts", key_series="k")):
        got = mapping.scale_down(mapping.build_mapping([rule], gens), ts).groupBy("point").agg(F.sum("value").alias("v")).orderBy("point").collect()
        assert [round(r.v, 9) for r in got] == [100.0, 0.0]
    whole = mapping.scale_down(mapping.build_mapping([Rule("GENERATOR", "ts")], gens), ts, distribute=False)
    assert {r.value for r in whole.filter("point = 0").collect()} == {100.0}


def test_rules_are_checked():
    for bad in (dict(type="X", series="a"), dict(type="LOAD", series="a", variables=("targetP",)), dict(type="LOAD", series="a", key=1.0, key_series="b")):
        with pytest.raises(ValueError):
            Rule(**bad)


def test_planned_outages(spark):
    rows = [("ts", 1, 0, "FVALDI11_G"), ("ts", 1, 1, "FVALDI11_G,FVALDI12_G"), ("ts", 1, 2, None)]
    got = mapping.planned_outages(spark.createDataFrame(rows, "name string, version int, point int, value string"))
    assert [r.value for r in got.filter("name = 'ts_FVALDI11_G'").orderBy("point").collect()] == [0.0, 0.0, 1.0]
    assert [r.value for r in got.filter("name = 'ts_FVALDI12_G'").orderBy("point").collect()] == [1.0, 0.0, 1.0]


def test_remedial_file(spark, tmp_path):
    path = tmp_path / "remedial.txt"
    path.write_text("NB;4;\nS_SO_1;1;SOO1_SOO1_DJ_OMN;\nS_SO_1;1;+SOO1_SOO1_DJ_OMN;\nS_SO_2|contrainte_1|contrainte_2;1;S_SO_3;\n")
    lines = checks.read_lines(spark, str(path))
    got = [(r.contingency, r.constraints, r.open, r.close) for r in checks.read_remedials(lines).orderBy("line_no").collect()]
    assert got == [("S_SO_1", [], ["SOO1_SOO1_DJ_OMN"], []), ("S_SO_1", [], [], ["SOO1_SOO1_DJ_OMN"]), ("S_SO_2", ["contrainte_1", "contrainte_2"], ["S_SO_3"], [])]
    assert [(r.line_no, r.problem) for r in checks.check_remedial_file(lines).collect()] == [(1, "count differs")]


RESULT = """C4 ;INCIDENTS;NUMERO;TYPE;OUVRAGE;
C4 ;;    1;N-1L;AIRVAL61JUMEA;
C2 ;;cty_connexity_2;1;;;
C2B ;;cty_connexity;CONSO1;100.0;
R4 ;;FS.BIS1;1;-360.000;
R4B ;;FS.BIS1;1;G;FSSV.O12_G;4.0;39.9;
R1B ;1;FVALDI1_1_0;11.1;
R1C ;Loads VALDI;-85.0;
R2 ;;CIVAU7;1495.0;755.5;-733.6;;
R3 ;;AIGREL41;1.4;;
R7 ;;BATTERY;-321.9;321.9;;;
R9 ;;0.0;1.0;2.0;3.0;4.0;;;12.3;
R10;;AIRVAL61JUMEA;1;BRANCH_1;
C1 ;;0;"""


def test_result_records(spark):
    rows = [("result_s10", 10, x) for x in RESULT.split("\n")] + [("result_s11", 11, "R3C ;;B;7;1.0;")]
    lines = spark.createDataFrame(rows, "file string, variant int, line string")
    got = {(r.variant, r.name): r.value for r in results.ingest_result_records(lines, spark.createDataFrame([(10,), (11,), (12,)], "variant int")).collect()}
    assert got == {
        (10, "LOST_LOAD_CONSO1_cty_connexity"): "100.0", (10, "MV_FS.BIS1_AIRVAL61JUMEA"): "-360.000", (10, "MV_POW_FS.BIS1_AIRVAL61JUMEA_FSSV.O12_G"): "4.0",
        (10, "MV_COST_FS.BIS1_AIRVAL61JUMEA_FSSV.O12_G"): "39.9", (10, "LOAD_CUR_FVALDI1_1_0_AIRVAL61JUMEA"): "11.1", (10, "LOAD_Loads VALDI"): "-85.0",
        (10, "INIT_BAL_GEN_CIVAU7"): "-733.6", (10, "FLOW_AIGREL41"): "1.4", (10, "BAT_VOL_DOWN_BATTERY"): "-321.9", (10, "BAT_VOL_UP_BATTERY"): "321.9",
        (10, "GEN_COST"): "0.0", (10, "BAT_COST"): "1.0", (10, "LOAD_COST"): "2.0", (10, "OVERLOAD_OUTAGES"): "3.0", (10, "OVERLOAD_BASECASE"): "4.0", (10, "LOAD_CUR_COST"): "12.3",
        (10, "TOPOLOGY_AIRVAL61JUMEA"): "BRANCH_1", (10, "ERROR_CODE"): "0", (11, "ERROR_CODE"): "1", (12, "ERROR_CODE"): "1",
    }


def test_zones_of_a_long_chain(spark):
    branches = spark.createDataFrame([(f"b{k}", k, k + 1, k != 30) for k in range(60)], "id string, node1 int, node2 int, closed boolean")
    got = {r.node: (r.zone, r.connected) for r in network.zones(branches).collect()}
    assert got[30] == (0, True) and got[31] == (31, False) and got[60] == (31, False)
    bridged = network.zones(branches, spark.createDataFrame([(2, 50)], "node1 int, node2 int"))
    assert {r.zone for r in bridged.collect()} == {0}


def test_conditions_as_text_and_as_columns(spark):
    rows = [(f"g{k}", "GENERATOR", "it's", "s", True, True, 0.0, 0.0, float(k), 0.0, 0.0, 0.0) for k in range(5)]
    gens = spark.createDataFrame(rows, COLUMNS)
    text = Rule("GENERATOR", "a'b\\c", where="voltage_level = 'it\\'s' AND max_p > 1", key="max_p * 2", ignore_limits=True)
    column = Rule("GENERATOR", "a'b\\c", where=(F.col("voltage_level") == "it's") & (F.col("max_p") > 1), key=F.col("max_p") * 2, ignore_limits=True)
    found = [sorted(map(tuple, mapping.build_mapping([r], gens).collect())) for r in (text, column)]
    assert found[0] == found[1] and len(found[0]) == 3 and found[0][0][3] == "a'b\\c"
