import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.fleet import conf, naming, routes, status, users

NOW = dt.datetime(2024, 2, 1, 12)


@pytest.mark.parametrize(
    "ago,text",
    [
        (dt.timedelta(seconds=0), "0s"),
        (dt.timedelta(seconds=59, milliseconds=999), "59s"),
        (dt.timedelta(seconds=60), "1m"),
        (dt.timedelta(minutes=59, seconds=59), "59m"),
        (dt.timedelta(hours=1), "1h"),
        (dt.timedelta(hours=23, minutes=59), "23h"),
        (dt.timedelta(hours=24), "1d"),
        (dt.timedelta(days=364, hours=23), "364d"),
        (dt.timedelta(days=365), "1y"),
        (dt.timedelta(days=800), "2y"),
        (dt.timedelta(milliseconds=-500), "0s"),
        (dt.timedelta(seconds=-1, milliseconds=-999), "0s"),
        (dt.timedelta(seconds=-2), "<invalid>"),
    ],
)
def test_age_text(spark, ago, text):
    df = spark.createDataFrame([(NOW - ago,)], "t timestamp_ntz")
    found = df.select(status.age_text(F.col("t"), F.lit(NOW).cast("timestamp_ntz"))).first()[0]
    assert found == text


def test_age_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "t timestamp_ntz")
    assert df.select(status.age_text(F.col("t"), F.lit(NOW))).first()[0] == "N.A."


@pytest.fixture
def apps(spark):
    schema = """namespace string, name string, state string, error_message string,
        submission_ts timestamp_ntz, termination_ts timestamp_ntz, conf map<string,string>"""
    return spark.createDataFrame(
        [
            ("spark-jobs", "spark-sql-ann", "RUNNING", None, NOW, None, {naming.JDBC_PORT_KEY: "10019"}),
            ("spark-jobs", "spark-sql-default", "FAILED", "boom", NOW, NOW, {}),
            ("spark-jobs", "etl", "RUNNING", None, None, None, None),
            ("other", "spark-sql-bob", "RUNNING", None, None, None, None),
        ],
        schema,
    )


def test_fleet_status(apps):
    found = {
        r["name"]: r
        for r in status.fleet_status(apps, F.lit(NOW).cast("timestamp_ntz"), "x.io", True).collect()
    }
    ann = found["spark-sql-ann"]
    assert ann["driver_url"] == "https://spark.x.io/proxy/spark/spark-jobs/spark-sql-ann"
    assert ann["jdbc_svc"] == "jdbc:hive2://spark-sql-ann-jdbc-svc:10019"
    assert (ann["submission_age"], ann["termination_age"]) == ("0s", "N.A.")
    assert found["spark-sql-default"]["jdbc_svc"] == found["etl"]["jdbc_svc"] == "null"


def test_paths_need_both_parts(spark):
    df = spark.createDataFrame([("n", "a"), ("", "a"), ("n", None)], "ns string, name string")
    found = df.select(naming.ui_path(F.col("ns"), F.col("name")), naming.jdbc_path(F.col("ns"), F.col("name")))
    assert [tuple(r) for r in found.collect()] == [
        ("/proxy/spark/n/a", "/proxy/spark-jdbc/n/a"), ("", ""), ("", ""),
    ]


def test_state_lookup(spark, apps, rows):
    asked = spark.createDataFrame([("ann",), ("",), (None,), ("bob",)], "user string")
    found = status.state_lookup(asked, apps)
    assert rows(found, "name", "state", "message", "found") == [
        ("spark-sql-ann", "RUNNING", None, True),
        ("spark-sql-bob", None, None, False),
        ("spark-sql-default", "FAILED", "boom", True),
        ("spark-sql-default", "FAILED", "boom", True),
    ]


def test_get_or_create(spark, apps, rows):
    asked = spark.createDataFrame(
        [(3, "bob"), (1, "bob"), (2, "ann"), (4, "")], "at long, user string"
    )
    found = status.get_or_create(asked, apps, ["at"])
    assert rows(found, "name", "at", "requests", "origin", "service") == [
        ("spark-sql-ann", 2, 1, "reused", "spark-sql-ann-jdbc-svc"),
        ("spark-sql-bob", 1, 2, "created", "spark-sql-bob-jdbc-svc"),
        ("spark-sql-default", 4, 1, "reused", "spark-sql-default-jdbc-svc"),
    ]


def test_latest_record(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "name string, at int, state string"
    )
    assert rows(status.latest(df, ["name"], ["at"]), "name", "at", "state") == [
        ("a", 2, None), ("b", 1, "z"),
    ]


def test_resources(spark):
    schema = "driver_cores int, driver_mem string, executor_cores int, executor_mem string"
    df = spark.createDataFrame([(None, None, 3, "2g"), (0, "1g", None, None)], schema)
    first, second = conf.resolve_resources(df).collect()
    assert first.asDict() == {
        "driver_cores": 1, "driver_core_limit": "1100m", "driver_mem": "512m",
        "executor_cores": 3, "executor_core_limit": "3300m", "executor_mem": "2g",
    }
    assert second["driver_core_limit"] == "0m" and second["executor_core_limit"] == "1100m"


def test_conf_overlay(spark):
    schema = "extra map<string,string>"
    df = spark.createDataFrame([({"spark.a": "2", "a": "3", "spark.b": "4"},), ({},), (None,)], schema)
    base = conf.constant_map({"spark.a": "1", "spark.c": "5"})
    found = [r[0] for r in df.select(conf.overlay(base, F.col("extra"))).collect()]
    plain = {"spark.a": "1", "spark.c": "5"}
    assert found == [{"spark.a": "2", "spark.b": "4", "spark.c": "5"}, plain, plain]


@pytest.mark.parametrize(
    "text,value",
    [
        ("4", 4), ("+7", 7), ("-3", -3), ("007", 7), (" 4 ", 0), ("x", 0), ("", 0), ("1_2", 0),
        ("4.0", 0), ("0x1f", 0), ("2147483647", 2147483647), ("2147483648", 0), ("1e3", 0), (None, 0),
    ],
)
def test_setting_as_int(spark, text, value):
    df = spark.createDataFrame([({"maxcores": text},)], "sets map<string,string>")
    assert df.select(users.setting_as_int(F.col("sets"), "maxcores")).first()[0] == value


def test_missing_settings(spark):
    df = spark.createDataFrame([({"other": "4"},), (None,)], "sets map<string,string>")
    assert [tuple(r) for r in users.quotas(df).select("maxcores", "maxmemory").collect()] == [(0, 0)] * 2


def test_insert_unique(spark, rows):
    asked = spark.createDataFrame([(5, "a"), (1, "b"), (2, "b"), (3, "admin")], "at long, username string")
    taken = spark.createDataFrame([("admin",), ("admin",)], "username string")
    assert rows(users.insert_unique(asked, taken, ["at"]), "at", "outcome") == [
        (1, "created"), (2, "duplicate"), (3, "exists"), (5, "created"),
    ]


def test_patches(spark):
    stored = spark.createDataFrame(
        [("a", 1, 100, "old", NOW), ("b", 2, 200, "old", NOW)],
        "username string, maxcores int, maxmemory int, password_digest string, uptime timestamp_ntz",
    )
    later = NOW + dt.timedelta(hours=1)
    patches = spark.createDataFrame(
        [
            (1, "a", users.MAX_CORES, 8, 999, "n", NOW),  # memory and password not in its mode
            (2, "a", users.MAX_CORES, 0, 0, "", later),  # zero leaves the stored value
            (3, "a", users.MAX_CORES_AND_MEMORY, 0, 300, None, later),
            (4, "a", users.PASSWORD, 9, 9, "new", later),
            (5, "a", 7, 9, 9, "newer", later + dt.timedelta(hours=1)),  # no such mode
            (6, "ghost", users.MAX_CORES, 9, 9, "n", later),
        ],
        """n long, username string, mode int, maxcores int, maxmemory int, password_digest string,
           ts timestamp_ntz""",
    )
    found = {r["username"]: tuple(r)[1:] for r in users.apply_patches(stored, patches, ["n"]).collect()}
    assert found == {"a": (8, 300, "new", later, 4), "b": (2, 200, "old", NOW, 0)}


def test_passwords_are_salted_digests(spark):
    df = spark.createDataFrame([("s1", "pw"), ("s2", "pw")], "salt string, pw string")
    found = df.select(users.password_digest(F.col("salt"), F.col("pw")).alias("d")).collect()
    assert found[0]["d"] != found[1]["d"] and all(len(r["d"]) == 64 for r in found)


def test_audit(spark, rows):
    usage = spark.createDataFrame(
        [("a", 2, 10), ("a", 3, 10), ("b", 9, 9), ("c", 1, 1)], "username string, cores int, memory int"
    )
    quotas = spark.createDataFrame(
        [("a", 4, 20), ("b", 0, 0)], "username string, maxcores int, maxmemory int"
    )
    assert rows(users.audit(usage, quotas), "username", "cores", "over_cores", "over_memory") == [
        ("a", 5, True, False), ("b", 9, False, False), ("c", 1, False, False),
    ]


def test_routes(spark, rows):
    df = spark.createDataFrame(
        [
            ("a", "ns", "u1", [("s1", "web", "web", 4040, "/p"), ("s2", "tcp", "hive2", 10019, "/q")]),
            ("b", "ns", "u2", [("s3", "udp", "x", 1, ""), ("s4", "web", "web", 80, None)]),
            ("c", "ns", "u3", []),
            ("d", "ns", "u4", None),
        ],
        "name string, namespace string, uid string, services array<struct<servicename:string,"
        "servicetype:string,entrypoint:string,serviceport:int,routepath:string>>",
    )
    assert rows(routes.route_table(df, "x.io"), "service", "kind", "rule", "port") == [
        ("s1", "IngressRoute", "Host(`spark.x.io`) && PathPrefix(`/p`)", 4040),
        ("s2", "IngressRouteTCP", "HostSNI(`*`)", 10019),
        ("s4", "IngressRoute", "Host(`spark.x.io`) && PathPrefix(``)", 80),
    ]


def test_lookup_and_status_take_the_last_record(spark, rows):
    from datetime import datetime

    from millrace.fleet import naming

    records = spark.createDataFrame(
        [(naming.ENGINE_NAMESPACE, "spark-sql-ann", "FAILED", "old", datetime(2024, 1, 1), None, {}), (naming.ENGINE_NAMESPACE, "spark-sql-ann", "RUNNING", None, datetime(2024, 1, 2), None, {})],
        "namespace string, name string, state string, error_message string, submission_ts timestamp, termination_ts timestamp, conf map<string,string>",
    )
    asked = spark.createDataFrame([("ann",)], "user string")
    assert rows(status.state_lookup(asked, records), "state", "message", "found") == [("RUNNING", None, True)]
    as_of = F.lit(datetime(2024, 1, 3))
    assert [r["state"] for r in status.fleet_status(records, as_of, "d").collect()] == ["RUNNING"]
