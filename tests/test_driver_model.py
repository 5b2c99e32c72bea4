"""The DataFrame mappings of the driver tables equal their DuckDB mirrors,
so every oracle comparison starts from the same clinical rows."""

import os

import pytest

from ehrflow.plans import catalog as C
from ehrflow.plans import driver_model as M
from tests.oracle_check import canon, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name, cte, table", [
    ("patients", M.PATIENTS_SQL, "patients"), ("encounters", M.ENCOUNTERS_SQL, "encounters"),
    ("professionals", M.PROFESSIONALS_SQL, "professionals"), ("technologies", C._TECH_SQL, "tech")])
def test_mapping_matches_mirror(spark, name, cte, table):
    con = duck(SF)
    res = con.execute(M.with_ctes(cte, body=f"SELECT * FROM {table}"))
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sdf = M.model(spark, SF, name).select(*dcols)
    assert canon(dcols, drows)[2] == canon(sdf.columns, [tuple(r) for r in sdf.collect()])[2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_access_requests_match_mirror(spark):
    con = duck(SF)
    res = con.execute(M.with_ctes(M.ACCESS_REQUESTS_SQL, body="SELECT * FROM access_requests"))
    dcols = [d[0] for d in res.description]
    sdf = M.access_requests(M.read(spark, SF, "events")).select(*dcols)
    assert canon(dcols, res.fetchall())[2] == canon(sdf.columns, [tuple(r) for r in sdf.collect()])[2]
