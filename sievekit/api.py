"""The public operators in one place (names of SURVEY §7.2)."""

from sievekit.functions.scalars import (  # noqa: F401
    blank_to_null, blanks_to_null, column_range, flag_eq, hash_key, if_else, normalise_doi, normalise_text,
    paste, percent, ratio, round_half_even, select_range, to_number,
)
from sievekit.operators.aggregates import (  # noqa: F401
    any_match, count_equal, error_lists, group_summary, label_conflicts, performance,
)
from sievekit.operators.agreement import agreement_summary, decisions_for_model, flips, run_agreement  # noqa: F401
from sievekit.operators.citations import citation_clusters, citation_fields, dedup_citations  # noqa: F401
from sievekit.operators.dedup import dedup, default_keys, exact_clusters, near_copy_clusters  # noqa: F401
from sievekit.operators.filters import criteria_screen, filter_out, keep, regex_criterion  # noqa: F401
from sievekit.operators.joins import anti_ids, flag_by_member, flag_ids, semi_ids, split_train_unseen, title_link  # noqa: F401
from sievekit.operators.model import (  # noqa: F401
    embedding_features, encoder_features, fit_priority, hashed_text_features, lambda_max, score,
)
from sievekit.operators.near_titles import near_keys, title_link_near  # noqa: F401
from sievekit.operators.order import (  # noqa: F401
    drop_top_share, head_rows, lag_first, last_relevant_fraction, rank_list, recall_curve, recall_threshold,
    slice_max, stopping_runs, tail_rows,
)
from sievekit.operators.sampling import first_per_key, sample_n, sample_strata, shuffle_rows  # noqa: F401
from sievekit.operators.sets import bind_rows, unique_values, with_constants  # noqa: F401
from sievekit.plans.components import connected_components  # noqa: F401
from sievekit.plans.corpus import build_corpus  # noqa: F401
from sievekit.plans.global_order import lag_rows, rank_rows  # noqa: F401
from sievekit.plans.priority import priority_screening, screening_split  # noqa: F401
from sievekit.sources.report import read_report, write_report  # noqa: F401
from sievekit.sources.ris import read_ris, write_ris  # noqa: F401
from sievekit.sources.tables import load_table, save_table  # noqa: F401
from sievekit.streaming.decisions import start_summary  # noqa: F401


def agreement(a, b, key: str = "eppi_id", decision: str = "decision_binary"):
    """(cross-tab, summary) of two runs' decisions."""
    x = run_agreement(a, b, key, decision)
    return x, agreement_summary(x)
