"""Bills, documents and pages derived from the part table.

The SQL is common to Spark and the checking database. A tenth of the master rows share one
meter number; documents differ from their row in ten ways by the last digit of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.sources.fixtures import COLUMN_TO_FIELD

_KEY = "cast(p_partkey as string)"
_NAME = "upper(concat(p_name, ' ', p_type))"
_ADDRESS = (
    "concat('JL. ', upper(p_name), ' NO.', cast(p_size as string), ' RT00', "
    "cast(p_partkey % 7 as string), ', ', upper(replace(p_brand, '#', ' ')))"
)
_METER = f"case when p_partkey % 10 = 7 then 'JTX0' else concat('JTX', cast(p_partkey + 100 as string)) end"
_START, _USAGE = "1000 + p_partkey % 40000", "20 + p_size * 10"
_TARIFF = (
    "case p_partkey % 6 when 0 then 'R1/1300 VA' when 1 then 'R1-2200 VA' when 2 then 'R1M/900 VA' "
    "when 3 then 'r2/3500 va' when 4 then 'B1/2200 VA' else 'X9/1 VA' end"
)
_BILL = f"({_USAGE}) * (1300 + p_partkey % 300)"

MASTER = {
    "id_pelanggan": f"concat('53', lpad({_KEY}, 10, '0'))",
    "nama_pelanggan": _NAME,
    "alamat": _ADDRESS,
    "tarif_daya": _TARIFF,
    "nomor_meter": _METER,
    "nomor_kwh": "cast(85200000 + p_partkey as string)",
    "periode": "'Januari 2026'",
    "stand_meter_awal": f"cast({_START} as string)",
    "stand_meter_akhir": f"cast({_START} + {_USAGE} as string)",
    "pemakaian_kwh": f"cast({_USAGE} as string)",
    "biaya_listrik": f"cast({_BILL} as string)",
}


def _by_digit(cases: dict[int, str], otherwise: str) -> str:
    listed = " ".join(f"when {d} then {sql}" for d, sql in cases.items())
    return f"case p_partkey % 10 {listed} else {otherwise} end"


_ABSENT = "cast(null as string)"
DOCUMENT = {
    "id_pelanggan": _by_digit(
        {1: _ABSENT, 2: _ABSENT, 6: f"concat('99', {_KEY})", 7: _ABSENT, 9: _ABSENT}, MASTER["id_pelanggan"]
    ),
    "nama_pelanggan": _by_digit(
        {2: f"replace({_NAME}, 'I', 'Y')", 3: f"lower({_NAME})", 5: _ABSENT, 6: "'QQQ WWW'"}, _NAME
    ),
    "alamat": _by_digit(
        {2: f"replace({_ADDRESS}, 'RT00', 'RT 0')", 6: "'ZZZ 99'", 8: f"replace({_ADDRESS}, 'JL. ', 'Jalan ')"}, _ADDRESS
    ),
    "tarif_daya": _by_digit({0: f"concat({_TARIFF}, ' X')"}, _TARIFF),
    "nomor_meter": _by_digit({2: f"concat('ZZ', {_KEY})", 6: f"concat('ZZ', {_KEY})", 9: _ABSENT}, _METER),
    "nomor_kwh": MASTER["nomor_kwh"],
    "periode": _by_digit({4: "'Februari 2026'"}, "'Januari 2026'"),
    "stand_meter_awal": _by_digit({9: f"cast({_START} + 9999 as string)"}, MASTER["stand_meter_awal"]),
    "stand_meter_akhir": _by_digit({3: f"cast({_START} + {_USAGE} + 30 as string)"}, MASTER["stand_meter_akhir"]),
    "pemakaian_kwh": _by_digit({1: _ABSENT, 3: f"cast({_USAGE} + 32 as string)", 8: "'0'"}, MASTER["pemakaian_kwh"]),
    "biaya_listrik": _by_digit({4: f"concat('Rp ', cast({_BILL} as string))", 8: "'0'"}, MASTER["biaya_listrik"]),
}


def select_sql(key: str, columns: dict[str, str], table: str = "part") -> str:
    cells = ", ".join(f"{sql} as {name}" for name, sql in columns.items())
    return f"select {key}, {cells} from {table}"


MASTER_SQL = select_sql("p_partkey as row_idx", MASTER)
DOCUMENT_SQL = select_sql(f"concat('D', {_KEY}) as doc_id", DOCUMENT)

#: Every 97th bill is planted: its readings and amounts are far off all others.
_PLANTED = {"stand_meter_awal": "900000000", "stand_meter_akhir": "990000000", "pemakaian_kwh": "90000000", "biaya_listrik": "999000000000"}
PLANTED = DOCUMENT | {f: f"case when p_partkey % 97 = 0 then '{v}' else {DOCUMENT[f]} end" for f, v in _PLANTED.items()}
PLANTED_SQL = select_sql(f"concat('D', {_KEY}) as doc_id", PLANTED)

# Two printed pages per part; the last digit of the key decides which labels are odd.
_LF = "chr(10)"
_PAGE_1 = _by_digit(
    {
        1: f"concat('Rekening Listrik ', {MASTER['id_pelanggan']}, {_LF}, 'Nama Pelanggan : ', {_NAME}, {_LF}, 'Alamat : ', {_ADDRESS})",
        2: f"concat('ID Pelanggan : ', {MASTER['id_pelanggan']}, {_LF}, 'Nama : ', {_NAME}, {_LF}, 'Tarif/Daya :')",
        3: "''",
        4: f"concat('IDPEL ', {MASTER['id_pelanggan']}, {_LF}, 'Pelanggan : ', {_NAME}, {_LF}, 'Alamat Rumah : ', {_ADDRESS}, {_LF}, 'Tagihan JTX', {_KEY})",
    },
    f"concat('ID Pelanggan : ', {MASTER['id_pelanggan']}, {_LF}, 'Nama Pelanggan : ', {_NAME}, {_LF}, "
    f"'Alamat : ', {_ADDRESS}, {_LF}, 'Tarif/Daya : ', {_TARIFF})",
)
_PAGE_2 = _by_digit(
    {
        2: f"concat('R1/1300 VA', {_LF}, 'No. Meter : ', {_METER}, {_LF}, 'Pemakaian (kWh) : ', {MASTER['pemakaian_kwh']})",
        5: f"concat('Meter No : ', {_METER}, {_LF}, 'LWBP Awal ', {MASTER['stand_meter_awal']}, {_LF}, 'Total Tagihan Rp. 352.500')",
    },
    f"concat('Nomor Meter : ', {_METER}, {_LF}, 'Nomor kWh : ', {MASTER['nomor_kwh']}, {_LF}, 'Periode : Januari 2026', {_LF}, "
    f"'Stand Meter Awal : ', {MASTER['stand_meter_awal']}, {_LF}, 'Stand Meter Akhir : ', {MASTER['stand_meter_akhir']}, {_LF}, "
    f"'Pemakaian : ', {MASTER['pemakaian_kwh']}, ' kWh', {_LF}, 'Biaya Listrik : Rp ', {MASTER['biaya_listrik']})",
)
_PAGE_SQL = "select concat('D', {key}) as doc_id, {n} as page_number, {text} as text from part"
PAGES_SQL = " union all ".join(
    _PAGE_SQL.format(key=_KEY, n=n, text=text) for n, text in ((1, _PAGE_1), (2, _PAGE_2))
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cells(part: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    return part.select(F.expr(key), *(F.expr(sql).alias(name) for name, sql in columns.items()))


def master(spark: SparkSession, folder: str) -> DataFrame:
    fields = _cells(table(spark, folder, "part"), "p_partkey as row_idx", MASTER)
    return fields.withColumnsRenamed({f: c for c, f in COLUMN_TO_FIELD.items()})


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(table(spark, folder, "part"), f"concat('D', {_KEY}) as doc_id", DOCUMENT)


def planted(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(table(spark, folder, "part"), f"concat('D', {_KEY}) as doc_id", PLANTED)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    both = F.expr(
        f"inline(array(named_struct('page_number', 1, 'text', {_PAGE_1}), named_struct('page_number', 2, 'text', {_PAGE_2})))"
    )
    return part.select(F.expr(f"concat('D', {_KEY}) as doc_id"), both)
