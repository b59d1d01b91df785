"""Layer jobs: bronze ingest, silver clean, gold mart, and the full run."""

from tierloom.plans.bronze import ingest
from tierloom.plans.gold import customer_sales, run_gold
from tierloom.plans.medallion import Layers, run_medallion
from tierloom.plans.silver import clean, run_silver

__all__ = ["Layers", "clean", "customer_sales", "ingest", "run_gold", "run_medallion", "run_silver"]
