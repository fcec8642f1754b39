"""Word lists, thresholds, messages and lookup rows that results depend on."""

# --- fixed values: stop words -------------------------------------------------------------
NANO_STOP = (
    "the a an is are was were be been being have has had do does did will would could should "
    "may might shall can this that these those it its they them their of in on at to for with "
    "by from up out as into through and or but not so if then than about which who what how "
    "when where"
).split()

MESH_STOP = (
    "a an the is are was were be been being have has had do does did will would could should "
    "may might shall can to of in on at for with by from up and or but not so if then than "
    "about which who what how when where"
).split()

STEP_STOP = (
    "the a an is are was were be been have has do does will would could should may might can "
    "this that it of in on at to for with by from and or but not if than which who what"
).split()

NO_STOP: list[str] = []

# --- fixed values: hedging phrases and question prefixes ------------------------------------
HEDGES = [
    "not sure", "uncertain", "unclear", "might", "may", "possibly", "perhaps", "i think",
    "i believe", "probably", "likely", "seems", "appear", "could be", "doubt", "unsure",
    "i'm not", "don't know",
]
FACTOID_PREFIXES = ["who ", "when ", "where ", "what year", "which ", "how many", "how much"]
NO_RESULT_PHRASES = ["no results", "not found"]

# --- fixed values: risk cuts ----------------------------------------------------------------
MEDIUM_FROM = 0.50
LOW_FROM = 0.70
ALERT_AT = 0.70
JUDGE_RISK = {"GOOD": 0.25, "BORDERLINE": 0.55, "POOR": 0.85}
STEP_JUDGE_RISK = {"LOW": 0.25, "MEDIUM": 0.55, "HIGH": 0.85}
JUDGE_CALL_COST = 0.007

# --- fixed values: drift and adaptive thresholds --------------------------------------------
PSI_WARN = 0.10
PSI_ALARM = 0.20
CUSUM_K = 0.5
CUSUM_H = 5.0
DRIFT_WINDOW = 50
DRIFT_MIN = 20
PSI_EPS = 1e-4
PSI_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001,
             0.7000000000000001, 0.8, 0.9, 1.0]
CISC_STEP = 0.02
CISC_MIN = 0.25
CISC_MAX = 0.90
CISC_HIGH = 0.50
CISC_LOW = 0.70
ALERT_DEDUP_SECONDS = 300

# --- fixed values: messages -----------------------------------------------------------------
REPAIR_HINTS = {
    "empty_output": "No output produced. Start with foundational background facts.",
    "confident_wrong": "Verify: search for a source that confirms the specific claim.",
    "retrieval_fail": "Searches returned no results. Use broader / alternative terminology.",
    "repeated_query": "Force query deduplication — no repeat of prior searches.",
    "long_chain": "Too many steps. Focus on the single most important fact.",
}

FAILURE_HINTS = {
    "retrieval_fail": "its searches found no relevant results — try different terminology or a "
                      "different source angle",
    "repeated_query": "it kept repeating the same search without progress — avoid any terms from "
                      "the original query",
    "long_chain": "it used too many steps and got lost — simplify to the single most important "
                  "fact",
    "empty_answer": "it could not produce a final answer — start with the most basic verifiable "
                    "fact",
    "low_retrieval_quality": "its retrieved context was not relevant — try a more specific or "
                             "more general framing",
    "no_evidence": "searches returned results with no overlap to the question — try foundational "
                   "background facts first",
}
FAILURE_HINT_DEFAULT = ("it was uncertain — try a fresh perspective with different vocabulary and "
                        "framing")
TIME_SENSITIVE_SUFFIX = (" Also note: this question is time-sensitive — explicitly look for "
                         "recent information.")

# --- fixed values: recovery adapters (id, mode, strategy, temperature, step cap, priority, hint)
ADAPTERS = [
    ("retrieval_fail_v1", "retrieval_fail", "broaden_query", 0.2, None, 1,
     "Previous searches returned no relevant results. Use DIFFERENT terminology — synonyms, "
     "broader terms, or related concepts. Avoid repeating any term used in prior searches."),
    ("repeated_query_v1", "repeated_query", "deduplicate", 0.0, None, 2,
     "You previously issued the same search query more than once without progress. You MUST NOT "
     "repeat any previous search query. Before each search, check your prior queries and ensure "
     "the new query is distinct."),
    ("long_chain_v1", "long_chain", "direct_fact", 0.0, 2, 3,
     "You are using too many steps. Focus on the single most important fact needed to answer the "
     "question. Answer directly after finding that one fact — do not continue searching."),
    ("empty_answer_v1", "empty_answer", "foundational", 0.1, None, 4,
     "You failed to produce a final answer. Start by identifying the single most basic, "
     "verifiable fact about this topic. Once you find any concrete fact, use it to construct a "
     "partial answer rather than searching indefinitely."),
    ("low_retrieval_quality_v1", "low_retrieval_quality", "decompose", 0.1, None, 2,
     "Retrieved context has low relevance to the question. Try a more specific search using "
     "proper nouns and exact names, or a more general search using only the core concept."),
    ("no_evidence_v1", "no_evidence", "foundational", 0.0, None, 2,
     "Your searches returned results with no overlap to the question. Start with foundational "
     "background facts before targeting the specific question. Build up from basics."),
    ("confident_wrong_v1", "confident_wrong", "verify_claim", 0.0, 3, 1,
     "Your previous answer was made with very few reasoning steps and no expressed uncertainty. "
     "This pattern often indicates overconfidence. Verify your answer explicitly: search for a "
     "source that CONFIRMS the specific claim in your answer. If you cannot verify it, express "
     "uncertainty and try an alternative."),
    ("default_v1", "default", "default", 0.0, None, 10,
     "Consider whether you have enough evidence to answer confidently. If uncertain, try a "
     "different search angle before finalising."),
]

# --- fixed values: routing cascade (tier, model, $ per 1M input, $ per 1M output) -----------
CASCADE = [
    ("low", "claude-haiku-4-5-20251001", 0.80, 4.00),
    ("medium", "claude-sonnet-4-6", 3.00, 15.00),
    ("high", "claude-opus-4-6", 15.00, 75.00),
]

# --- fixed values: candidate blend weights --------------------------------------------------
BANDIT_ARMS = [0.50, 0.65, 0.75, 0.85, 0.90]
FAILURE_MODES = ["retrieval_fail", "repeated_query", "long_chain", "no_evidence"]
