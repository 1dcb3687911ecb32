"""sievekit: Spark-native operators for screening bibliographic records.

Records are read from citation files or tables, cleaned, sampled, split into
training and unseen sets, ranked by a text classifier and measured with
confusion counts, recall curves and stopping-rule runs. Every operator takes
and returns DataFrames; order-dependent steps carry an explicit ``ordinal``
column instead of relying on partition order.
"""

from sievekit.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
