"""Reading and writing tables."""

from tessera.sources.csv import BadHeader, read_csv, write_csv
from tessera.sources.generate import coinsurance, cohort, generate_one_to_one, generate_other, generate_tpch, partsupp
from tessera.sources.tables import TABLES, load, load_integers

__all__ = ["BadHeader", "TABLES", "coinsurance", "cohort", "generate_one_to_one", "generate_other", "generate_tpch", "load", "load_integers", "partsupp", "read_csv", "write_csv"]
