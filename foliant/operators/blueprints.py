"""What kind of document a text is (prompt, blueprint, guideline, documentation, note, code), what kind of blueprint, whether it carries foreign or
sensitive matter, and how complete it is as a blueprint.

As in context.py, SIGNALS are expressions that a text has or lacks, and decisions are SQL over them, all within the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import Gates, folded
from foliant.functions.text import alternation, half_up, strip, utf16_length
from foliant.operators.context import HEADING, by_name, counted, matched, matching, steps, without_code

# Expressions, weights and texts that results depend on. Upper and lower case are equal; ^ and $ are ends of lines, \A is the text's beginning.
SIGNALS = {
    "s_role": r"(?:you are (?:a|an)\s|du bist (?:ein|eine)\s|act as (?:a|an)\s|agiere als\s|role\s*:\s*[a-z]|rolle\s*:\s*[a-z])",
    "s_output": r"(?:return\s+(?:as|a|in|the)|output\s*(?:format|as|should)|respond\s+(?:with|in|using)|gib\s+(?:zurück|aus)\s+(?:als|in))",
    "s_verb_en": r"\A(?:write|create|generate|explain|summarize|translate|convert|list|describe|analyze|review|fix|implement|update)\s",
    "s_verb_de": r"\A(?:schreibe|erstelle|generiere|erkläre|fasse\s+zusammen|übersetze|konvertiere|liste|beschreibe|analysiere|prüfe|behebe|implementiere|aktualisiere)\s",
    "s_chatty": r"(?:can you|kannst du|please|bitte|would you|würdest du|help me|hilf mir|what (?:is|are)|was (?:ist|sind))",
    "s_example": r"(?:example|beispiel|e\.g\.|for instance|zum beispiel|z\.b\.|input.*output)",
    "h_role": r"^#+\s*(?:rolle|role)\b", "h_task": r"^#+\s*(?:aufgabe|task)\b", "h_output": r"^#+\s*(?:ergebnisformat|output\s*format)\b",
    "h_window": r"^#+\s*(?:kontextfenster-empfehlung|context\s*window|context\s*recommendation)\b", "h_requirements": r"^#+\s*(?:anforderungen|requirements)\b", "h_constraints": r"^#+\s*(?:hard\s*constraints|constraints|einschränkungen)\b",
    "w_verification": r"^#+\s*(?:verification\s*contract|verifikation|acceptance\s*criteria)\b", "w_approval": r"^#+\s*(?:human\s*approval(?:\s*gate)?|review\s*scope)\b",
    "w_evidence": r"^#+\s*(?:evidence|nachweise?|belege?)\b", "w_workflow": r"^#+\s*(?:agenten-workflow|workflow|arbeitsphasen|red\s*tests)\b",
    "b_architecture": r"(?:system\s*architecture|systemarchitektur|component\s*(?:diagram|architecture|overview)|komponenten\s*(?:diagramm|architektur|übersicht)|architektur\s*(?:entscheidung|überblick|diagramm)|architecture\s*(?:decision|overview|diagram)|deployment\s*(?:architecture|model|diagram))",
    "b_roadmap": r"(?:phase\s*[1-9]|phase\s*(?:one|two|three)|sprint\s*[1-9]|milestone\s*[1-9]|roadmap|fahrplan|iteration\s*[1-9]|release\s*(?:plan|schedule)|MVP|minimum viable product|minimales\s+produkt)",
    "b_plan": r"(?:implementation\s*plan|umsetzungsplan|implementierungsplan|work\s*breakdown|arbeitspakete|deliverables|liefergegenstände|task\s*breakdown|aufgaben\s*liste)",
    "b_data": r"(?:data\s*flow|datenfluss|data\s*model|datenmodell|entity\s*relationship|ER\s*diagram|API\s*(?:design|contract|endpoint)|schema\s*(?:design|definition)|database\s*(?:schema|design|migration))",
    "b_security": r"^#+\s*(?:security|sicherheit|compliance|datenschutz|privacy|data\s*protection|GDPR|DSGVO|auth|authorization|threat\s*model)",
    "b_verification": r"(?:verification\s*contract|verifikations\s*vertrag|acceptance\s*criteria|akzeptanz\s*kriterien|definition\s*of\s*done|fertig\s*stellungs\s*kriterien)",
    "b_risk": r"^#+\s*(?:risks?|risiken|known\s*limitations?|bekannte\s*einschränkungen|assumptions|annahmen|dependencies|abhängigkeiten)",
    "b_evidence": r"(?:evidence\s*portfolio|nachweis\s*portfolio|evidence\s*(?:required|must|artifacts)|test\s*evidence|CI\s*(?:pipeline|gate|status)|review\s*(?:agent|process|required))",
    "b_next": r"^#+\s*(?:next\s*steps?|nächste\s*schritte|handoff|übergabe|follow.?up|future\s*work|ausblick)",
    "b_agents": r"(?:agent\s*(?:role|responsibilit|type)|rolle\s*(?:des|der)\s*agenten|subagent|delegation\s*(?:rule|pattern)|reviewer|orchestrator)", "b_you": r"(?:you are|du bist|act as|agiere als)",
    "b_scope": r"^#+\s*(?:scope|umfang|in\s*scope|out\s*of\s*scope|what'?s\s*(?:in|out)|project\s*boundaries|projekt\s*grenzen)",
    "b_parts": r"(?:module|component|service|layer|schicht|backend|frontend|database|datenbank|API|middleware|gateway)",
    "y_workflow": r"(?:workflow|pipeline|step\s+\d|process\s+flow|implement.*then.*test|code.*review.*merge|deploy.*pipeline)",
    "y_repository": r"(?:github\.com/\w+/\w+|gitlab\.com|bitbucket\.org|repository|repo\b|branch|commit|merge|pull\s*request|PR\b)",
    "y_issue": r"(?:issue\s*[#:]\s*\d+|ticket\s*[#:]\s*\d+|task\s*[#:]\s*\d+|github\s*issue)",
    "g_title": r"^#+\s*(?:System-Richtlinie|Richtlinie|Guideline|Policy|Regelwerk|Leitlinie|Standards?|Prinzipien)\b",
    "g_directive": r"(?:Verzichte auf|Verwende|Achte auf|Halte dich|Nutze|Vermeide|Stelle sicher|Definiere|Fasse|Teile|Gilt als)\b",
    "g_rules": r"^#+\s*(?:Regeln?|Do|Don't|Guardrails|Constraints|Vorgaben?|Prinzipien|Anweisungen)\b",
    "g_terms": r"(?:Token-Effizienz|BatchPrompting|Batch-Verarbeitung|Ausgabequalität|Skeleton-of-Thought|Kontext-Management|Output-Management|Prompt\s*Engineering|Token-?Budget)",
    "t_architecture": r"(?:architektur|architecture|datenfluss|data\s*flow)", "t_workflow": r"(?:workflow|human approval|reviewer-agent|verification contract|red tests)",
    "t_security": r"(?:security|sicherheit|datenschutz|privacy|oauth|jwt|gdpr|dsgvo)", "t_evidence": r"(?:evidence|nachweis|beleg|screenshot|test output|gate status)",
    "c_app": r"(?:Positron|MietVisor|CiviPet)\b",
    "c_secret": r"""(?:api[_-]?key\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}['"]|secret\s*[:=]\s*['"][A-Za-z0-9_\-]{12,}['"]|token\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}['"]|password\s*[:=]\s*['"][^'"]{4,}['"]|access[_-]?key\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}['"])""",
    "c_run": r"(?:run\s*report|test run|test\s*results?)\s*(?:from|vom|dated?)\s*(?:202[0-5]|2026-[0-1][0-9]-\d{2})", "c_fresh": r"freshness|fresh|aktualität|stand:|as of:",
    "c_trace": r"(?-i:at\s+\w+\.\w+\s*\(.*:\d+:\d+\)|Caused by:|Exception in thread|panic:|thread '.*' panicked)", "c_handling": r"error\s*handling|fehler\s*behandlung|debugging|troubleshooting",
    "c_chat": r"(?:User:|Assistant:|Human:|AI:|Bot:|user\s*said|assistant\s*replied|previous\s*message|vorherige\s*nachricht)", "c_sample": r"example|beispiel|sample|vorlage",
    "c_legal": r"(?:personalausweis|reisepass|geburtsdatum|sozialversicherungsnummer|steuer\s*id|steuer\s*nummer|bankverbindung|IBAN.*DE|kontonummer)",
    "c_linux": r"(?:ubuntu|debian|fedora|centos|red\s*hat|arch\s*linux|linux|bash|zsh)", "c_windows": r"(?:windows|powershell|cmd|win32|msys|mingw)", "c_mac": r"(?:macos|darwin|os\s*x|apple)",
    "c_model": r"(?:running\s*(?:on|with)|powered\s*by|using\s*(?:model|agent))\s*(?:GPT-5|Claude\s*[4-9]|Gemini\s*[3-9])",
    "d_goal": r"^#+\s*(?:ziel|goal|objective|zweck|purpose|vision|target)", "d_measurable": r"(?:messbar|measurable|quantit|prozent|percent|KPI|metrik|metric|OKR|success\s*(?:criteria|metric)|erfolgs\s*kriterien)",
    "d_scope": r"^#+\s*(?:scope|umfang|in\s*scope|out\s*of\s*scope|what'?s\s*(?:in|out)|boundaries|grenzen)", "d_mvp": r"(?:MVP|minimum viable|minimales\s+(?:produkt|set)|phase\s*1|first\s*(?:release|iteration)|v1\.0|initial\s*(?:release|version|scope))",
    "d_excluded": r"(?:out\s*of\s*scope|nicht\s+(?:im|teil)|ausgeschlossen|excluded|not\s+(?:included|relevant|planned))",
    "d_components": r"(?:component|komponente|module|service|layer|schicht|microservice|API\s*(?:gateway|endpoint)|database|datenbank)", "d_flow": r"(?:data\s*flow|datenfluss|pipeline|request\s*flow|message\s*queue|event\s*(?:bus|driven)|async|synchronous)",
    "d_stack": r"(?:tech\s*stack|technology\s*stack|technologie\s*stack|React|TypeScript|Rust|Tauri|Node\.js|PostgreSQL|SQLite|Docker|Kubernetes)",
    "d_phases": r"(?:phase\s*[1-9]|sprint\s*[1-9]|iteration\s*[1-9]|step\s*\d|schritt\s*\d)", "d_effort": r"(?:effort|aufwand|estimat|schätzung|story\s*points?|person\s*(?:days?|weeks?|months?)|manntage|t-shirt\s*(?:size|sizing))",
    "d_dependencies": r"(?:dependenc|abhängigkeit|prerequisite|voraussetzung|blocked\s*by|requires|benötigt|depends\s*on)",
    "d_risk": r"^#+\s*(?:risks?|risiken|known\s*limitations?|bekannte\s*einschränkungen|threats?|bedrohungen|challenges?|herausforderungen)", "d_mitigation": r"(?:mitigation|gegenmaßnahme|fallback|rollback|revert|backup|sicherung|contingency|notfall\s*plan)",
    "d_assumption": r"(?:assumption|annahme|hypothesis|hypothese|assumed|angenommen)",
    "d_security": r"^#+\s*(?:security|sicherheit|privacy|datenschutz|data\s*protection|auth|authorization)",
    "d_measures": r"(?:encryption|verschlüsselung|JWT|OAuth|OAuth2|TLS|HTTPS|RBAC|role.based|rate\s*limit|input\s*validation|sanitization|GDPR|DSGVO|consent|einwilligung|data\s*minimization|retention)",
    "d_personal": r"(?:PII|personenbezogen|personal\s*data|sensitive\s*data|data\s*classification|data\s*flow|encryption\s*(?:at\s*rest|in\s*transit))",
    "d_tests": r"^#+\s*(?:tests?|testing|testen|test\s*(?:strategy|plan|approach)|QA|quality\s*assurance)", "d_verification": r"^#+\s*(?:verification\s*contract|verifikation|acceptance\s*criteria)",
    "d_test_types": r"(?:unit\s*tests?|integration\s*tests?|e2e|end.to.end|regression\s*tests?|visual\s*tests?|playwright|vitest|jest|cargo\s*test)", "d_red": r"(?:red\s*tests?|failing\s*tests?|tests?\s*(?:must|should)\s*(?:fail|pass)|before.*green|before.*pass)",
    "d_evidence": r"^#+\s*(?:evidence|nachweise?|belege?|proof|verification|verifikation|acceptance|akzeptanz)", "d_artifacts": r"(?:screenshot|bildschirmfoto|log\s*(?:file|output)|test\s*output|test\s*report|CI\s*(?:pipeline|status)|gate\s*(?:status|report)|diff\s*stat)",
    "d_contract": r"(?:verification\s*contract|verify\s+that|prüfe\s+dass|checklist|checkliste|definition\s*of\s*done)",
    "d_context": r"^#+\s*(?:context|kontext|background|hintergrund|environment|umgebung|project\s*(?:overview|überblick))", "d_fresh": r"(?:stand\s*:|as\s*of|dated?|vom|last\s*updated|current\s*as\s*of|version\s+\d+\.\d+|freshness|aktualität)",
    "d_next": r"^#+\s*(?:next\s*steps?|nächste\s*schritte|handoff|übergabe|follow.?up|action\s*items?|todo)", "d_action": r"(?:implement|create|write|deploy|merge|release|review|test|document|approve|genehmigen)",
    "d_priority": r"(?:priority|priorität|urgent|dringend|high|medium|low|blocker|blocked|next|first|zuerst)",
}
COUNTS = {
    "n_headings": HEADING, "n_lines": r"^[^\S\n]*[^\s#]", "n_symbols": r"[{}=;<>\[\]|&]", "n_listed": r"^[^\S\n]*[-*\d+.][^\S\n]+\S",
    "n_imperative": r"^[^\S\n]*(?:Verzichte|Verwende|Achte|Halte|Nutze|Vermeide|Definiere|Stelle|Fasse|Teile|Prüfe|Validier|Do not|Don't|Always|Never|Use|Avoid|Ensure|Define|Keep|Apply)",
}


def number(*names: str) -> str:
    return "(" + " + ".join(f"CAST({n} AS INT)" for n in names) + ")"


PROMPT = {
    "role_definition": "s_role", "output_format_request": "s_output", "simple_task_verb": "s_verb_en OR s_verb_de", "chatty_style": "s_chatty", "few_shot_examples": "s_example AND n_units < 3000",
    "sectioned_agent_prompt": number("h_role", "h_task", "h_output", "h_window", "h_requirements", "h_constraints") + " >= 2",
}
BLUEPRINT = {
    "system_architecture": "b_architecture", "roadmap_phases": "b_roadmap", "implementation_plan": "b_plan", "data_flow": "b_data", "security_compliance_section": "b_security", "verification_contract": "b_verification",
    "risk_limitations": "b_risk", "evidence_portfolio": "b_evidence", "next_steps_handoff": "b_next", "defined_roles_not_prompt": "b_agents AND NOT b_you", "scope_definition": "b_scope",
    "multi_component_structure": "n_headings >= 6 AND b_parts", "workflow_governance_sections": number("w_verification", "w_approval", "w_evidence", "w_workflow") + " >= 2",
}
HYBRID = {"agent_workflow": "y_workflow", "repo_reference": "y_repository", "issue_tracking": "y_issue"}
GUIDELINE = {"guideline_title": "g_title", "guideline_directive": "g_directive", "guideline_rule_section": "g_rules", "guideline_domain_terms": "g_terms", "guideline_imperative_rules": "n_lines >= 5 AND n_imperative >= 2"}
STRONG = ("verification_contract", "evidence_portfolio", "implementation_plan", "workflow_governance_sections")
CONTAMINATION = {
    "foreign_app_name": ("medium", "c_app"), "stale_project_name": ("high", "stale_names"), "potential_secret": ("critical", "c_secret"), "stale_run_report": ("medium", "c_run AND NOT c_fresh"),
    "raw_stacktrace": ("low", "c_trace AND NOT c_handling"), "chat_artifact": ("low", "c_chat AND NOT c_sample"), "private_legal_data": ("high", "c_legal"),
    "contradictory_runtime": ("medium", number("c_linux", "c_windows", "c_mac") + " > 1"), "unverifiable_model_claim": ("low", "c_model"), "foreign_url": ("low", "foreign_urls"),
}
KNOWN_URLS = ("github.com/cli", "github.com/tauri", "nodejs.org", "rust-lang.org", "npmjs.com")
URL = r"https?://[^\s)]+"
#: Asked in order: condition, class and confidence. p, b, s, g, h: signals of prompts, blueprints, strong ones of these, guidelines, both.
LADDER = (
    ("n_units > clean_units AND clean_units < (n_units - clean_units) * 0.5", "CODE_FRAGMENT", "0.9"),
    ("g >= 2 AND p <= 1 AND s <= 1", "GUIDELINE", "least(greatest(0.55 + g * 0.08, 0.55), 0.95)"),
    ("n_headings >= 2 AND p = 0 AND s = 0 AND b <= 4 AND g <= 1", "DOC", "0.8"),
    ("clean_units < 300 AND p = 0 AND b = 0 AND g = 0 AND h = 0", "NOTE", "0.85"),
    ("p >= 1 AND b = 0 AND h < 3", "PROMPT", "least(greatest(0.5 + p * 0.1 - h * 0.05, 0.5), 0.95)"),
    ("b >= 2 AND p = 0 AND s >= 1", "BLUEPRINT", "least(greatest(0.5 + b * 0.07, 0.5), 0.95)"),
    ("b >= 3 AND p = 0", "BLUEPRINT", "least(greatest(0.5 + b * 0.07 - h * 0.03, 0.5), 0.9)"),
    ("p >= 2 AND b = 0", "PROMPT", "0.7"),
    ("b > p AND b >= 2 AND s >= 1", "PROMPT_BLUEPRINT_HYBRID", "least(greatest(0.4 + (b + p) * 0.05, 0.4), 0.85)"),
    ("p > b AND b >= 2 AND s >= 1", "PROMPT_BLUEPRINT_HYBRID", "least(greatest(0.3 + (b + p) * 0.06, 0.3), 0.8)"),
    ("p >= 2 AND b = 1", "PROMPT", "0.6"),
    ("p >= 1 AND b >= 2 AND s >= 1", "PROMPT_BLUEPRINT_HYBRID", "least(greatest(0.3 + (b + p) * 0.08, 0.4), 0.85)"),
    ("p >= 1 AND s = 0 AND b <= 2", "PROMPT", "least(greatest(0.4 + p * 0.05, 0.4), 0.75)"),
)
UNKNOWN = "UNKNOWN_NEEDS_REVIEW"
UNKNOWN_CONFIDENCE = "CASE WHEN p + b + g + h = 0 THEN 0.25 WHEN p + b + g + h <= 2 THEN 0.3 ELSE least(greatest(0.3 + (p + b + g + h) * 0.03, 0.3), 0.5) END"
CLASS_SQL = "CASE WHEN blank THEN '" + UNKNOWN + "' " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in LADDER) + f" ELSE '{UNKNOWN}' END"
CONFIDENCE_SQL = "CASE WHEN blank THEN 0.3D " + " ".join(f"WHEN {c} THEN {v}" for c, _, v in LADDER) + f" ELSE {UNKNOWN_CONFIDENCE} END"
#: Kinds of blueprint: priority, expressions that each count one, and the one expression that is asked where no kind counts any.
TYPES = {
    "architecture_blueprint": (2, (r"(?:architecture|architektur|system\s*design|layered\s*architecture)", r"(?:component\s*(?:diagram|architecture)|komponenten\s*(?:diagramm|architektur))", r"(?:data\s*flow|datenfluss|entity\s*relationship|ER\s*diagram|microservice|monolith)")),
    "security_blueprint": (2, (r"(?:security|sicherheit|threat\s*model|bedrohungs\s*modell)", r"(?:vulnerability|schwachstelle|penetration\s*test|CVE)", r"(?:authorization|OAuth[^A-Za-z]|JWT)")),
    "compliance_blueprint": (1, (r"(?:compliance|GDPR|DSGVO|HIPAA|SOX|ISO\s*27001)", r"(?:audit|prüfung|privacy|datenschutz|data\s*protection)", r"(?:consent|einwilligung|retention|aufbewahrung)")),
    "deployment_blueprint": (1, (r"(?:deployment|bereitstellung|infrastructure|infrastruktur)", r"(?:kubernetes|docker|container|cloud|AWS|Azure|GCP)", r"(?:CI/CD|pipeline|release\s*(?:plan|process)|monitoring|logging)")),
    "agent_workflow_blueprint": (3, (r"(?:agent\s*(?:workflow|role|responsibility)|subagent|delegation|orchestrator)", r"(?:issue.*orchestrator|review.*agent|security.*agent|research.*agent|playwright.*agent)", r"(?:verification\s*contract|human\s*approval|red\s*tests|review\s*scope|evidence)")),
    "implementation_blueprint": (1, (r"(?:implementation\s*plan|umsetzungsplan|task\s*breakdown|work\s*breakdown)", r"(?:phase\s*[1-9]|sprint\s*[1-9]|milestone|MVP|roadmap)")),
    "product_blueprint": (1, (r"(?:product\s*(?:vision|roadmap|strategy)|produkt\s*(?:vision|strategie))", r"(?:feature\s*(?:plan|list|roadmap)|user\s*story|persona|market\s*(?:analysis|fit))")),
}
GENERIC, AGENT = "generic_blueprint", "agent_workflow_blueprint"
#: Dimension: name, weight, and what 2 and 1 need.
DIMENSIONS = {
    "goal_clarity": ("Goal Clarity", 0.15, "d_goal AND d_measurable", "d_goal"), "scope_sharpness": ("Scope Sharpness", 0.15, "d_scope AND d_mvp AND d_excluded", "d_scope"),
    "architecture": ("Architecture Completeness", 0.15, "d_components AND d_flow AND d_stack", "d_components"), "feasibility": ("Feasibility / Implementability", 0.1, "d_phases AND d_effort AND d_dependencies", "d_phases"),
    "risk_coverage": ("Risk Coverage", 0.1, "d_risk AND d_mitigation AND d_assumption", "d_risk"), "security_privacy": ("Security & Privacy", 0.1, "d_security AND d_measures AND d_personal", "d_security"),
    "testability": ("Testability", 0.05, "(d_tests OR d_verification) AND d_test_types AND d_red", "d_tests OR d_verification"), "evidence_readiness": ("Evidence Readiness", 0.05, "d_evidence AND d_artifacts AND d_contract", "d_evidence"),
    "context_purity": ("Context Purity", 0.1, "clean AND d_context AND d_fresh", "clean"), "next_step_clarity": ("Next Step Clarity", 0.05, "d_next AND d_action AND d_priority", "d_next"),
}
MISSING = {
    "Goal Clarity": 'Add an explicit goal section with measurable success criteria. E.g., "## Goal — Deliver a working MVP with all CI gates green."',
    "Scope Sharpness": "Define clear scope boundaries: what is in scope, what is out of scope, and what defines the MVP cut.",
    "Architecture Completeness": "Add architecture details: component overview, data flow, and technology stack choices.",
    "Feasibility / Implementability": "Add implementation phases with effort estimates and dependency ordering.",
    "Risk Coverage": 'Add a "Risks & Known Limitations" section with mitigations, fallback plans, and explicit assumptions.',
    "Security & Privacy": "Add a security section covering authentication, authorization, data handling, and privacy compliance.",
    "Testability": 'Define a test strategy: what test types are needed, how red tests work, and what "all green" means.',
    "Evidence Readiness": "Add an evidence section specifying which artifacts prove completion (screenshots, test reports, CI status, diff stats).",
    "Context Purity": "Ensure all context references are relevant to this blueprint. Remove foreign app names, stale run reports, and unverifiable claims.",
    "Next Step Clarity": 'Add a "Next Steps" section with concrete, prioritized actions for the next implementer.',
}
PARTIAL = {
    "Goal Clarity": "Make the goal more measurable with specific KPIs or success criteria.",
    "Scope Sharpness": "Sharpen the MVP cut line — what exactly is in the first deliverable?",
    "Architecture Completeness": "Add more architecture details — consider adding a data flow diagram description or tech stack summary.",
    "Feasibility / Implementability": "Add effort estimates or story points for each phase to improve planning accuracy.",
    "Risk Coverage": "Add specific mitigations or fallback plans for each identified risk.",
    "Security & Privacy": "Add specific security measures (encryption, auth protocol, input validation rules).",
    "Testability": "Add specific test commands (e.g., `pnpm test`) and expected pass/fail counts.",
    "Evidence Readiness": "Specify exact evidence artifact types needed and where to post them.",
    "Context Purity": "Add a freshness/version marker and remove any lingering foreign project references.",
    "Next Step Clarity": "Add priorities (high/medium/low) or an ordering to the next steps.",
}
TAGS = {
    "GUIDELINE": "g_title OR g_directive OR g_rules", "AGENT_PROMPT": PROMPT["sectioned_agent_prompt"] + " OR s_role", "ARCHITECTURE": "b_architecture OR b_data OR t_architecture",
    "WORKFLOW": BLUEPRINT["workflow_governance_sections"] + " OR t_workflow", "SECURITY": "b_security OR t_security", "EVIDENCE": "b_evidence OR t_evidence", "CONTAMINATION_RISK": "NOT clean",
}
#: Condition and reason, in order; then what is said of texts of no known class, and of texts without any other reason.
REASONS = (
    (PROMPT["sectioned_agent_prompt"], "Structured agent-prompt headings detected: Rolle/Aufgabe/Ergebnisformat/Kontext."),
    (BLUEPRINT["workflow_governance_sections"], "Workflow governance sections detected: Verification Contract, Human Approval, Evidence, or Red Tests."),
    ("b_architecture OR b_data", "Blueprint structure detected from architecture or data-flow terminology."),
    ("content_class = 'DOC' AND b > s", "Documentation with architecture/documentation terms but no actionable blueprint criteria (acceptance criteria, verification, implementation plan)."),
    ("content_class = 'DOC' AND b = s", "Structured headings were present, but prompt and blueprint signals stayed below the decision threshold."),
    ("content_class = 'GUIDELINE'", "Guideline/policy document detected with directive language and rule-oriented structure."),
    ("content_class = 'PROMPT'", "Content classified as a task prompt: role, goal, or instruction patterns detected, but no blueprint/guideline structure."),
    ("content_class = 'CODE_FRAGMENT'", "Content appears to be a code fragment with minimal prompt or blueprint structure."),
)
EMPTY = "Empty or whitespace-only content: no signals available for classification."
TOO_SHORT = "Content too short for reliable classification: insufficient text for signal detection."
LOW_SIGNAL = "Low signal: no role, task, requirements, architecture, documentation or guideline structure detected."
TITLE_ONLY = "Title-only content: headings present but insufficient body text for a reliable classification."
CODE_LIKE = "Code-like fragment: content appears to be code, config, or shell syntax without enough explanatory context for classification."
LIST_ONLY = "List-only content: bullet-point list detected without surrounding prose for reliable classification."
LIMITED = "Content contains structured headings but limited classifier signals."
EMPTY_DETAILS, EMPTY_WARNING, EMPTY_MISSING = "Missing: blueprint has no content.", "Blueprint content is empty. Add content to enable evaluation.", "No blueprint content to evaluate."
EMPTY_ADVICE = ("goal_clarity", "Goal Clarity", "Start by defining the blueprint's goal: what should this blueprint achieve?", "high")
LOW_BARE = "Low confidence because: only limited blueprint evidence was detected."


#: Of all expressions that run over a whole text.
GATES = Gates(*SIGNALS.values(), *COUNTS.values(), *(p for _, ps in TYPES.values() for p in ps))


def named(groups: dict[str, str]) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*(F.when(F.expr(sql), n) for n, sql in groups.items())))


def unknown_reasons() -> Column:
    """Why a text has no class. Columns as in classified()."""
    several = lambda kind, names: F.when(F.size(names) > 0, F.concat(F.size(names).cast("string"), F.lit(f" {kind} signal(s) ("), F.array_join(names, ", "), F.lit(")")))
    parts = F.array_compact(F.array(several("weak prompt", "prompt_signals"), several("weak blueprint", "blueprint_signals"), several("weak guideline", "guideline_signals"), several("hybrid", "hybrid_signals")))
    mixed = F.concat(F.lit("Mixed weak signals: "), F.array_join(parts, "; "), F.lit(" present, but none strong enough for a reliable "), F.when(F.col("n_headings") >= 2, "PROMPT, BLUEPRINT, DOCUMENTATION or GUIDELINE").otherwise("classification"), F.lit("."))
    shapes = F.array_compact(F.array(
        F.when(F.expr("n_headings > 0 AND clean_units < n_headings * 25 + 60"), TITLE_ONLY),
        F.when(F.expr("n_symbols > 0.12 * clean_units OR (n_units > clean_units AND clean_units < (n_units - clean_units) * 2)"), CODE_LIKE),
        F.when(F.expr("n_all_lines > 3 AND n_listed > 0.45 * n_all_lines"), LIST_ONLY),
    ))
    none = F.lit(LOW_SIGNAL[:-1] + " for a reliable classification.")
    rest = F.when(F.size(shapes) > 0, shapes).otherwise(F.array(F.when(F.size(parts) > 0, mixed).otherwise(none)))
    return F.when(F.col("blank"), F.array(F.lit(EMPTY))).when(F.col("clean_units") < 50, F.array(F.lit(TOO_SHORT))).when(F.expr("clean_units < 200 AND p + b + g + h = 0"), F.array(F.lit(LOW_SIGNAL))).otherwise(rest)


def blueprint_type() -> Column:
    """The kind with most expressions; of these the one of the highest priority, then the first."""
    hybrid = (F.col("content_class") == "PROMPT_BLUEPRINT_HYBRID").cast("int")
    has = lambda p: matched("_t", {"x": p}, GATES)["x"].cast("int")
    scores = F.array(*(F.struct((sum(map(has, ps), F.lit(0)) + (hybrid if k == AGENT else 0)).alias("score"), F.lit(priority).alias("priority"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, (priority, ps)) in enumerate(TYPES.items())))
    best = F.array_max(scores)
    # No expression of a kind means none of the shorter list that would be asked instead either, so that only the generic kind is left.
    return F.when(F.col("content_class").isin("BLUEPRINT", "PROMPT_BLUEPRINT_HYBRID"), F.when(best["score"] > 0, best["kind"]).otherwise(GENERIC))


def signalled(docs: DataFrame, text: str, known_urls: Sequence[str], stale_names: Sequence[str]) -> DataFrame:
    df = docs.withColumn("_t", strip(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumns({"n_units": utf16_length(F.col("_t")), "clean_units": utf16_length(without_code(F.col("_t"))), "blank": F.col("_t") == "", "n_all_lines": F.size(F.split("_t", "\n", -1))})
    df = df.withColumn("_passed", GATES.passed(folded(F.col("_t"))))
    df = df.withColumns(matched("_t", SIGNALS, GATES) | counted("_t", COUNTS, GATES))
    known = lambda u: F.exists(F.array(*map(F.lit, known_urls)).cast("array<string>"), lambda k: F.contains(u, k))
    foreign = F.exists(F.regexp_extract_all("_t", F.lit(URL), F.lit(0)), lambda u: ~known(u))
    stale = F.col("_t").rlike(matching(rf"\b{alternation(stale_names)}\b")) if stale_names else F.lit(False)
    df = df.withColumns({"foreign_urls": foreign, "stale_names": stale})
    df = df.withColumns({"prompt_signals": named(PROMPT), "blueprint_signals": named(BLUEPRINT), "hybrid_signals": named(HYBRID), "guideline_signals": named(GUIDELINE), "contamination_signals": named({n: sql for n, (_, sql) in CONTAMINATION.items()})})
    size = {"p": F.size("prompt_signals"), "b": F.size("blueprint_signals"), "h": F.size("hybrid_signals"), "g": F.size("guideline_signals"), "s": F.size(F.filter("blueprint_signals", lambda x: x.isin(*STRONG))), "clean": F.size("contamination_signals") == 0}
    return df.withColumns(size)


RESULT = ("content_class", "blueprint_type", "contamination_status", "class_confidence", "class_tags", "class_reasons", "prompt_signals", "blueprint_signals", "guideline_signals", "contamination_signals")


def contamination_status(signals: Column) -> Column:
    of = lambda severity: F.exists(signals, lambda s: s.isin(*(n for n, (x, _) in CONTAMINATION.items() if x == severity)))
    return F.when(F.size(signals) == 0, "CLEAN").when(of("critical"), "BLOCKING_SENSITIVE_CONTENT").when(of("high"), "CONTAMINATED_NEEDS_REVIEW").otherwise("POSSIBLE_CONTAMINATION")


def _classified(docs: DataFrame, text: str, known_urls: Sequence[str], stale_names: Sequence[str]) -> DataFrame:
    df = signalled(docs, text, known_urls, stale_names).withColumn("content_class", F.expr(CLASS_SQL))
    joined = F.concat(F.lit("Contamination review signals detected: "), F.array_join("contamination_signals", ", "), F.lit("."))
    reasons = F.array_compact(F.array(*(F.when(F.expr(sql), x) for sql, x in REASONS), F.when(~F.col("clean"), joined)))
    df = df.withColumn("_reasons", reasons)
    unknown = F.col("content_class") == UNKNOWN
    more = F.when(unknown, F.concat(F.when(F.col("blank"), F.expr("cast(array() as array<string>)")).otherwise(F.col("_reasons")), unknown_reasons()))
    limited = F.when((F.size("_reasons") == 0) & (F.col("n_headings") >= 2), F.array(F.lit(LIMITED))).otherwise(F.col("_reasons"))
    return df.withColumns({
        "blueprint_type": blueprint_type(), "contamination_status": contamination_status(F.col("contamination_signals")), "class_confidence": half_up(F.expr(CONFIDENCE_SQL).cast("double") * 100) / 100,
        "class_tags": named(TAGS), "class_reasons": F.coalesce(more, limited),
    })


def classified(docs: DataFrame, text: str = "text", known_urls: Sequence[str] = KNOWN_URLS, stale_names: Sequence[str] = ()) -> DataFrame:
    """docs with content_class, blueprint_type (of blueprints and hybrids), contamination_status, class_confidence, class_tags, class_reasons, and the signals of each group.

    known_urls: parts of URLs that belong to the collection's own projects; stale_names: what these were called before. Null and blank texts are of no known class. Columns of the same names are replaced."""
    return _classified(docs, text, known_urls, stale_names).select(*(c for c in docs.columns if c not in RESULT), *RESULT)


def evaluated(docs: DataFrame, text: str = "text", known_urls: Sequence[str] = KNOWN_URLS, stale_names: Sequence[str] = ()) -> DataFrame:
    """classified(), with dimensions (dimension, name, score, max_score, details), a score from 0 to 100 for each, blueprint_score, and strengths, warnings,
    missing_elements, improvements, blueprint_confidence and reasons. Blank texts score 0 in everything."""
    df = _classified(docs, text, known_urls, stale_names)
    df = df.withColumns({f"{d}_score": F.when(F.col("blank"), 0).otherwise(F.expr(f"50 * {steps(two, one)}")) for d, (_, _, two, one) in DIMENSIONS.items()})

    def dimension(d: str, name: str) -> Column:
        score = F.expr(f"CAST({d}_score / 50 AS INT)")
        details = F.when(F.col("blank"), EMPTY_DETAILS).when(score == 0, f"Missing: {name} is not addressed.").when(score == 1, f"Partially present: {name} could be strengthened.").otherwise(f"Clearly defined: {name} is well-specified.")
        return F.struct(F.lit(d).alias("dimension"), F.lit(name).alias("name"), score.alias("score"), F.lit(2).alias("max_score"), details.alias("details"))

    df = df.withColumn("dimensions", F.array(*(dimension(d, name) for d, (name, *_) in DIMENSIONS.items())))
    mean = sum((F.col(f"{d}_score") * weight for d, (_, weight, _, _) in DIMENSIONS.items()), F.lit(0.0))
    told = lambda score: F.transform(F.filter("dimensions", lambda x: x["score"] == score), lambda x: F.concat(F.lit("["), x["dimension"], F.lit("] "), x["name"], F.lit(": "), x["details"]))
    names = F.array_join("contamination_signals", ", ")
    alarm = F.when(F.col("contamination_status").isin("CONTAMINATED_NEEDS_REVIEW", "BLOCKING_SENSITIVE_CONTENT"), F.concat(F.lit("CONTAMINATION: "), names, F.lit(" detected. Review required.")))
    alarm = alarm.when(F.col("contamination_status") == "POSSIBLE_CONTAMINATION", F.concat(F.lit("Possible contamination: "), names, F.lit(". Verify before using.")))
    advice = lambda score, table, priority: F.transform(F.filter("dimensions", lambda x: x["score"] == score), lambda x: F.struct(x["dimension"].alias("dimension"), x["name"].alias("criterion"), by_name(table, x["name"]).alias("message"), F.lit(priority).alias("priority")))
    share = F.size(F.filter("dimensions", lambda x: x["score"] > 0)) / len(DIMENSIONS)
    confidence = 0.2 + share * 0.8
    gaps = F.transform(F.filter("dimensions", lambda x: x["score"] == 0), lambda x: x["name"])
    low = F.when(F.size(gaps) == 0, LOW_BARE).otherwise(F.concat(F.lit("Low confidence because: missing "), F.array_join(F.slice(gaps, 1, 3), ", "), F.when(F.size(gaps) > 3, ", and other blueprint sections").otherwise(""), F.lit(".")))
    told_blank = lambda text: F.array(F.lit(text))
    one = F.array(F.struct(*(F.lit(x).alias(n) for n, x in zip(("dimension", "criterion", "message", "priority"), EMPTY_ADVICE, strict=True))))
    df = df.withColumns({
        "blueprint_score": F.greatest(F.lit(0), F.least(F.lit(100), half_up(mean))).cast("int"), "blueprint_strengths": told(2), 
        "blueprint_warnings": F.when(F.col("blank"), told_blank(EMPTY_WARNING)).otherwise(F.concat(F.array_compact(F.array(alarm)), told(1))), "blueprint_missing": F.when(F.col("blank"), told_blank(EMPTY_MISSING)).otherwise(told(0)),
        "blueprint_improvements": F.when(F.col("blank"), one).otherwise(F.concat(advice(0, MISSING, "high"), advice(1, PARTIAL, "medium"))), "blueprint_confidence": F.when(F.col("blank"), 1.0).otherwise(half_up(confidence * 100) / 100),
        "class_reasons": F.when((confidence < 0.6) & ~F.col("blank"), F.concat("class_reasons", F.array(low))).otherwise(F.col("class_reasons")),
    })
    new = (*RESULT, *(f"{d}_score" for d in DIMENSIONS), "dimensions", "blueprint_score", "blueprint_strengths", "blueprint_warnings", "blueprint_missing", "blueprint_improvements", "blueprint_confidence")
    return df.select(*(c for c in docs.columns if c not in new), *new)
