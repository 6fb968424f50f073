"""A published sample of bus card uses with its per-row quality.

The instant of that analysis follows from the listed scores, which agree on it.
"""

import pytest

from gaugeframe import AssessmentConfig
from gaugeframe.plans import extended_dataset
from helpers import by

NOW = "2018-04-03 14:42:17.844845"
FORMAT = "%d/%m/%y %H:%M:%S,%f"

# Line, name, vehicle, card, instant and the expected timeliness.
USES = [
    ("542", "BAIRRO NOVO B", "GA130", "0002357837", "02/05/17 17:26:30,000000", "0.539356383415"),
    ("000", "OPER S/LINHA", "09053", "0002357837", "02/05/17 17:58:40,000000", "0.539387018336"),
    ("000", "OPER S/LINHA", "09053", "0002357837", "02/05/17 17:58:35,000000", "0.539386938971"),
    ("213", "SÃO JOÃO", "BC913", "0002619557", "02/05/17 12:38:33,000000", "0.53908214532"),
    ("000", "OPER S/LINHA", "03055", "0002619557", "02/05/17 20:55:25,000000", "0.539555351669"),
    ("021", "INTERB II ANTI H", "08046", "0001937533", "02/05/17 20:16:13,000000", "0.539518018336"),
    ("021", "INTERB II ANTI H", "04002", "0001937533", "02/05/17 13:08:08,000000", "0.539110319923"),
]
COLUMNS = ["CODLINHA", "NOMELINHA", "CODVEICULO", "NUMEROCARTAO", "DATAUTILIZACAO"]

# The valid pairs of line and name for these uses, and two others.
PAIRS = [
    ("542", "BAIRRO NOVO B"),
    ("000", "OPER S/LINHA"),
    ("213", "SÃO JOÃO"),
    ("021", "INTERB II ANTI H"),
    ("271", "LARANJEIRAS"),
    ("673", "FORMOSA"),
]


def test_golden_rows(spark):
    source = spark.createDataFrame([use[:5] for use in USES], COLUMNS)
    allowed = spark.createDataFrame(PAIRS, ["CODLINHA", "NOMELINHA"])
    config = AssessmentConfig(
        columns=COLUMNS,
        keys=[["CODLINHA", "CODVEICULO"], ["CODVEICULO"], ["NUMEROCARTAO"]],
        dimensions=["Completeness_Missing", "Timeliness", "Consistency-R"],
        granularity={name: ["tuple"] for name in ("Completeness_Missing", "Timeliness", "Consistency")},
        timestamps={"DATAUTILIZACAO": FORMAT},
        volatility_hours={"DATAUTILIZACAO": 17500},
    )
    out = by(extended_dataset(source, config, NOW, [allowed]), "CODVEICULO", "DATAUTILIZACAO")
    assert len(out) == len(USES)
    for use in USES:
        row = out[use[2], use[4]]
        assert row["COMPLETENESS_MISSING"] == "1.0"
        assert row["ASSOCIATION_CONSISTENCY"] == "1.0"
        assert float(row["TIMELINESS_DATAUTILIZACAO"]) == pytest.approx(float(use[5]), abs=1e-11)
        assert [row[c] for c in COLUMNS] == list(use[:5])
