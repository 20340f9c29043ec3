"""tessera: cross-script corpus preparation and multilingual evaluation as Spark plans.

Every public function takes and returns DataFrames (or Columns for the
``functions`` package); nothing is collected to the driver except
parameter-sized tables (rule sets, label maps, block counts).
"""

from tessera.session import get_spark, checkpoint_dir, stage_table

__all__ = ["get_spark", "checkpoint_dir", "stage_table"]
