"""Columns of the input tables: source name -> internal name."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: the headers of the input tables
PATIENT_COLUMNS = {
    "CIP": "cip",
    "municipi": "municipality",
    "UVE": "uve",
    "regió": "region",
    "contactes": "n_contacts",
    "orígen": "origin",
    "data naixement": "birth_date",
    "gènere": "gender",
}
PATIENT_OPTIONAL = ("regió",)
CONTACT_COLUMNS = {
    "cas": "case_cip",
    "municipi": "municipality",
    "àmbit contacte": "setting",
    "data naixement": "birth_date",
    "verificació": "outcome",
    "data verificació": "verified_at",
    "símptomes": "symptoms_day0",
    "estat": "status_1",
    "data": "date_1",
    "confinat casa": "isolated_1",
    "confinament altre": "reason_1",
    "símptomes2": "symptoms_1",
    "estat3": "status_2",
    "data4": "date_2",
    "confinat casa5": "isolated_2",
    "confinament altre6": "reason_2",
    "símptomes7": "symptoms_2",
}
GAZETTEER_COLUMNS = {
    "nom_unitat_de_poblacio": "place_name",
    "categoria": "category",
    "SVE": "sve",
    "nom_municipi": "municipality_name",
    "Provincia": "province",
}
CONVERTER_COLUMNS = {
    "SVE": "sve",
    "UVE": "uve",
    "RS": "region",
    "Provincia": "province",
    "SVE_corregida": "sve_display",
}
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("sve", T.StringType()),
        T.StructField("ci", T.LongType()),
        T.StructField("cni", T.LongType()),
        T.StructField("iso_year", T.IntegerType()),
        T.StructField("iso_week", T.IntegerType()),
    ]
)
