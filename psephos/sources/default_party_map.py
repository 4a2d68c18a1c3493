"""The party map the reference ships inline, as a ready input table.

The engine treats the party map as an input; this table lets a user of the
reference load the same map without writing it out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from psephos.sources.files import party_map_from_rows

# The reference's party map, in its order
# (party_name, canonical_name, short_code, alliance).
DEFAULT_PARTY_MAP_ROWS: tuple[tuple[str, str, str, str], ...] = (
    ("Bharatiya Janata Party", "Bharatiya Janata Party", "BJP", "NDA"),
    ("Janata Dal (United)", "Janata Dal (United)", "JDU", "NDA"),
    ("Lok Janshakti Party (Ram Vilas)", "Lok Janshakti Party (Ram Vilas)", "LJP(RV)", "NDA"),
    ("Hindustani Awam Morcha (Secular)", "Hindustani Awam Morcha", "HAM", "NDA"),
    ("Rashtriya Lok Morcha", "Rashtriya Lok Morcha", "RLM", "NDA"),
    ("Rashtriya Janata Dal", "Rashtriya Janata Dal", "RJD", "MGB"),
    ("Indian National Congress", "Indian National Congress", "INC", "MGB"),
    (
        "Communist Party of India (Marxist-Leninist) (Liberation)",
        "Communist Party of India (Marxist–Leninist)",
        "CPI(ML)",
        "MGB",
    ),
    ("Communist Party of India (Marxist)", "Communist Party of India (Marxist)", "CPI(M)", "MGB"),
    ("Indian Inclusive Party", "Indian Inclusive Party", "IIP", "MGB"),
    ("Communist Party of India", "Communist Party of India", "CPI", "MGB"),
    ("Vikassheel Insaan Party", "Vikassheel Insaan Party", "VIP", "MGB"),
    ("Jan Suraaj Party", "Jan Suraaj Party", "JSP", "OTHER"),
    ("Bahujan Samaj Party", "Bahujan Samaj Party", "BSP", "OTHER"),
    ("All India Majlis-E-Ittehadul Muslimeen", "All India Majlis-E-Ittehadul Muslimeen", "AIMIM", "OTHER"),
    ("Janshakti Janta Dal", "Janshakti Janta Dal", "JJD", "OTHER"),
    ("Aam Aadmi Party", "Aam Aadmi Party", "AAP", "OTHER"),
    ("Independent", "Independent", "IND", "IND"),
    ("None of the Above", "None of the Above", "NOTA", "NOTA"),
)


def default_party_map(spark: SparkSession) -> DataFrame:
    """The reference's 19-row party map as a DataFrame."""
    return party_map_from_rows(spark, DEFAULT_PARTY_MAP_ROWS)
