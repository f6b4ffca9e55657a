"""Parameters of the clinical preset.

Every operator takes its columns and limits as arguments; the values here are
the defaults the full pipeline runs with.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

INF = float("inf")

# Labels, bins and names below have to equal the published ones
# for results to line up.

EVENT_NAMES = {
    "death": "All Cause Death",
    "stroke": "Ischemic Stroke",
    "hem_stroke": "Hemorrhagic Stroke",
    "major_bleed": "Major Bleeding",
    "minor_bleed": "Minor Bleeding",
    "hosp": "Hospitalization",
    "sys_emb": "Systemic Embolism",
    "cardio_death": "Cardiovascular Death",
}

ACTION_LABELS = [
    "↓ > 20%", "↓ 10-20%", "↓ ≤ 10%", "Maintain",
    "↑ ≤ 10%", "↑ 10-20%", "↑ > 20%",
]

DOSE_BOUNDS = [-0.001, 5, 12.5, 17.5, 22.5, 27.5, 30, 32.5, 35, 45, 1000]
DOSE_LABELS = ["<=5", "(5, 12.5]", "(12.5, 17.5]", "(17.5, 22.5]",
               "(22.5, 27.5]", "(27.5, 30]", "(30, 32.5]", "(32.5, 35]",
               "(35, 45]", ">45"]
AGE_BOUNDS = [-0.001, 50, 60, 65, 70, 75, 80, 91]
AGE_LABELS = ["<=50", "(50, 60]", "(60, 65]", "(65, 70]", "(70, 75]",
              "(75, 80]", ">80"]
WEIGHT_BOUNDS = [-0.001, 55, 70, 80, 90, 100, 250]
WEIGHT_LABELS = ["<=55", "(55, 70]", "(70, 80]", "(80, 90]", "(90, 100]",
                 ">100"]
VALUE_LABELS = ["< 1.5", "1.5 - 2", "2 - 3", "3 - 3.5", "> 3.5"]
AUDIT_VALUE_BOUNDS = [0.0, 1.0, 2.0, 3.0, 4.0, INF]
AUDIT_VALUE_LABELS = ["< 1", "[1, 2)", "[2, 3]", "(3, 4]", "> 4"]
VALUE_CHANGE_BOUNDS = [-INF, -1.0, -0.25, 0.25, 1.0, INF]
VALUE_CHANGE_LABELS = ["Decrease > 1.0", "Decrease < 1.0", "Approx. Same",
                       "Increase < 1.0", "Increase > 1.0"]

TRIAL_END = "TRIAL_TERMINATION"
DOSE_INTERRUPTION = "DOSE_INR_INTERRUPTION"
TRIAL_INTERRUPTION = "TRIAL_INTERRUPTION"
ADVERSE_EVENT = "ADVERSE_EVENT"
TIME_GAP = "TIME_GAP"
UNINTUITIVE = "UNINTUITIVE_DECISION"

AGREEMENT_THRESHOLDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.15)
DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 30.4375

# Names in finished tables.
MODEL_NAMES = {"policy": "RL Algorithm", "threshold": "Rule-Based",
               "maintain": "Always Maintain", "random": "Random"}
ALGORITHM_NAMES = {"POLICY": "BCQ-SMDP", "THRESHOLD": "Benchmark Algorithm",
                   "MAINTAIN": "No Change", "RANDOM": "Random"}


@dataclass(frozen=True)
class Params:
    """Settings of the trajectory pipeline and of its evaluation."""

    daily_dose_trials: tuple[str, ...] = ("ENGAGE", "ROCKET_AF")
    avg_dose_trials: tuple[str, ...] = ("RELY",)
    weekly_dose_trials: tuple[str, ...] = ("ARISTOTLE",)
    test_trial: str = "RELY"
    val_trial: str = "ARISTOTLE"
    val_fraction: float = 0.2
    seed: int = 42

    static_cols: tuple[str, ...] = ("sex", "age", "weight", "continent",
                                    "country", "smoke", "diabetes")
    events_kept: tuple[str, ...] = ("death", "stroke", "major_bleed",
                                    "minor_bleed", "hem_stroke", "hosp",
                                    "sys_emb")
    events_splitting: tuple[str, ...] = ("death", "stroke", "major_bleed",
                                         "hem_stroke", "hosp", "sys_emb")
    events_evaluated: tuple[str, ...] = ("stroke", "hem_stroke",
                                         "major_bleed")
    dose_outlier: float = 140.0
    event_range: int = 90
    max_gap: int = 90
    min_rows: int = 2
    min_train_length: int = 5

    time_varying_across: bool = True
    prev_doses: bool = True
    prev_durations: bool = True
    discount: float = 0.99
    value_reward: float = 1.0
    event_reward: float = 0.0
    state_cols: tuple[str, ...] = field(default=(
        "age", "sex", "weight", "continent", "smoke", "diabetes", "value",
        "dose", "duration", "stroke_flag", "major_bleed_flag",
        "minor_bleed_flag", "hem_stroke_flag", "hosp_flag", "dose_bin",
        "age_bin", "weight_bin"))

    bootstrap: int = 1000


PERSONALIZED = Params()
VALUE_ONLY = replace(PERSONALIZED, prev_doses=False, prev_durations=False,
                     state_cols=("value",))
VALUE_DOSE = replace(PERSONALIZED, prev_doses=True, prev_durations=False,
                     state_cols=("value", "dose"))
