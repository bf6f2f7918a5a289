"""Decision-assurance analytics for agent workloads, on Spark."""

from ._ship import ship
from .operators.gates import DEFAULT_CHECKS, Check, View
from .plans.assurance import Case, CheckRow, Engine, evaluate
from .plans.digest import contract_digest, evidence_digest, manifest_digest
from .plans.frontier import ArmSummary, Comparison, FrontierCase, FrontierDecision, Plan, evaluate_frontier
from .report import analyst_context, case_json, case_markdown, frontier_json, frontier_markdown, frontier_svg
from .schemas import Baseline, Coverage, Decision, Evidence, EvidenceError, Mode, Policy, Status
from .sources.contracts import receipt, session_evidence, session_template, trace_evidence, trace_template
from .sources.files import bundle_of, csv_bundle, json_bundle, read_tables, write_bundle, write_tables
from .sources.frontier_files import read_experiment
from .sources.session_tree import read_tree
from .sources.sessions import Session, read_session, read_sessions

__all__ = [
    "ArmSummary", "Baseline", "Case", "Check", "CheckRow", "Comparison", "Coverage", "DEFAULT_CHECKS", "Decision", "Engine", "Evidence", "EvidenceError", "FrontierCase", "FrontierDecision", "Mode", "Plan", "Policy", "Session", "Status", "View",
    "analyst_context", "bundle_of", "case_json", "case_markdown", "contract_digest", "csv_bundle", "evaluate", "evaluate_frontier", "evidence_digest", "frontier_json", "frontier_markdown", "frontier_svg", "json_bundle", "manifest_digest",
    "read_experiment", "read_session", "read_sessions", "read_tables", "read_tree", "receipt", "session_evidence", "session_template", "ship", "trace_evidence", "trace_template", "write_bundle", "write_tables",
]
__version__ = "0.2.0"
