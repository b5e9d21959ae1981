"""Schemas of the engine's tables, as DDL strings."""

NODES = "node_id string, label string, embedding array<double>, activation double, protected boolean, node_type string, agreement double, recency double, ord long"
EDGES = "src string, dst string, edge_type string, base_weight double, agreement double, ord long"
DELTAS = "spec_id string, src string, dst string, delta double"
SPECULATIONS = "spec_id string, statement string, embedding array<double>, activation double, status string"
SECTIONS = "array<struct<heading: string, body: string, level: int, page: int>>"
DOCUMENTS = f"path string, title string, author string, date string, format string, raw_text string, sections {SECTIONS}, error string"
CHUNKS = "doc_id string, section_no int, position int, heading string, text string, char_start long"
OBSERVATIONS = "node_id string, pattern_embedding array<double>, confirmation_count int, diversity_score double, stabilisation_score double, sessions_active int, example_labels array<string>, entity_firing_counts map<string, int>"
STRUCTURAL = "node_id string, pattern_embedding array<double>, session_count int, diversity_score double, is_generalised boolean, attention_mode string, reactivation_count int"
LIBRARY_FILE = f"saved_at string, node_count int, observation_count int, nodes array<struct<{', '.join(x.replace(' ', ': ', 1) for x in STRUCTURAL.split(', '))}>>, observations array<struct<node_id: string, pattern_embedding: array<double>, confirmation_count: int, diversity_score: double, stabilisation_score: double, sessions_active: int, example_labels: array<string>, entity_firing_counts: map<string, int>>>, session_distributions map<string, array<array<double>>>"
