"""Parameters and fixed values of the experiment pipeline.

Everything a caller may want to vary is an argument of the operator that uses it;
this module only holds the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the analysed pipeline's for identical results -----------------
STAGING_MARKER = "staging"            # release_version containing this is a test build
SESSION_GAP_SECONDS = 1800            # inactivity time-out that starts a new session
ALPHA = 0.05                          # significance level
CONTROL = "Control"                   # control cohort label; every other label is a variation
VARIATION = "Variation"
DEFAULT_ZONE = "UTC"                  # zone used when the country has no usable time zone
SEQ_SEPARATOR = "|*|"                 # separator of the per-session event label sequence
LABEL_SEPARATOR = "-"                 # action-page_type label separator
EXPERIMENT = "Enhanced Autocomplete Search with personalized suggestions"
TEST_NAME = "Enhanced Autocomplete Search with Personalized Recommendations"

# raw event columns; together they are the exact-duplicate key
RAW_KEY = [
    "event_date", "event_name", "action", "event_datetime", "platform", "user_id",
    "login_status", "app_language", "release_version", "page_type", "ip_country", "cohort",
]

# funnel steps 2..6: (step number, count column, predicate on a clean event row)
SEARCH_EVENT = "Search_Event"
SEARCH_PAGE = "Destination Search"
SEARCH_ACTIVATED = "Search Activated"
SEARCH_SUBMITTED = "Search Submitted"
RESULTS_VIEWED = "Destination_Search_Page_Viewed"
ITEM_VIEWED = "view_item"
PURCHASE = "purchase"

# report steps: (step_id, label, flag column or None for all sessions, rule, count column)
#   rule "any" = flag > 0 (seen or implied by a later step), "seen" = flag = 1
REPORT_STEPS = [
    (1, "Session Start", None, "any", None),
    (2, "Search Activated", "step_2_flg", "any", "event_count_Search_Act"),
    (99, "Search Activated - step 2 specific so I can test and validate results",
     "step_2_flg", "seen", "event_count_Search_Act"),
    (3, "Search Submitted", "step_3_flg", "any", "event_count_Search_Sub"),
    (4, "Destination Search Results Page View", "step_4_flg", "any",
     "event_count_Destination_Viewed"),
    (5, "Viewed Destination Details", "step_5_flg", "any", "event_count_view_item"),
    (6, "Booked a Stay", "step_6_flg", "any", "event_count_purchase"),
]
# --- end of fixed values ----------------------------------------------------------------------


@dataclass(frozen=True)
class FunnelStep:
    """One funnel step after 'session start': its number, count column and event predicate."""

    number: int
    count_col: str
    event_name: str
    action: str | None = None
    page_type: str | None = None

    def predicate(self) -> Column:
        cond = F.col("event_name") == F.lit(self.event_name)
        if self.action is not None:
            cond = cond & (F.col("action") == F.lit(self.action))
        if self.page_type is not None:
            cond = cond & (F.col("page_type") == F.lit(self.page_type))
        return cond

    @property
    def flag_col(self) -> str:
        return f"step_{self.number}_flg"


FUNNEL_STEPS = [
    FunnelStep(2, "event_count_Search_Act", SEARCH_EVENT, SEARCH_ACTIVATED, SEARCH_PAGE),
    FunnelStep(3, "event_count_Search_Sub", SEARCH_EVENT, SEARCH_SUBMITTED, SEARCH_PAGE),
    FunnelStep(4, "event_count_Destination_Viewed", RESULTS_VIEWED),
    FunnelStep(5, "event_count_view_item", ITEM_VIEWED),
    FunnelStep(6, "event_count_purchase", PURCHASE),
]

# metrics tested by the significance operators
CONVERSION_METRICS = ["step_4_flg", "step_5_flg", "step_6_flg"]
AVERAGE_METRICS = ["event_count_Search_Sub"]

# skew handling of per-user sequences (see operators/timeline.py)
ROWS_PER_SLICE = 4_000_000     # a user with more rows than this is split into time slices
MAX_HOT_USERS = 100_000        # bound on the broadcast table of split users
