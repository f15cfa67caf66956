"""Schemas of all relations, as DDL; every reader and provider declares its schema, none is inferred."""

ANNOTATION = "struct<concept:string,category:string,label:string,label_type:string,confidence:string,evidence:string>"
LABEL = "struct<category:string,label:string,label_type:string,confidence:string,evidence:string>"

CODE_FILES = "path string, language string, code string"
ACTIVATIONS = "layer int, language string, path string, token_index int, token_id int, token string, feature_ids array<int>, feature_activations array<float>"
LLM_ANNOTATIONS = f"concept string, language string, path string, spans array<struct<start_line:int,end_line:int,text:string,match_method:string,annotations:array<{LABEL}>>>, no_pattern_detected boolean, error string"
GRAPH_ANNOTATIONS = "concept string, path string, variable_name string, line int, column int, code string, span_start int, span_end int, num_writes int"
TOKENS = "path string, token_index int, token_id int, token string, start_char int, end_char int"
TOKEN_LABELS = f"path string, language string, line int, column int, code string, variable_name string, token_index int, token_id int, token string, annotations array<{ANNOTATION}>, concepts array<string>"
AST_LABELS = "path string, language string, token_index int, token_id int, token string, start_byte int, end_byte int, concepts array<string>"
TREE = "path string, node_id int, parent_id int, preorder int, type string, is_named boolean, start_byte int, end_byte int"
PAIR_METRICS = "concept string, feature_id int, count_feature long, count_concept long, count_joint long, p_feature double, p_concept double, p_joint double, pmi double, npmi double, precision double, recall double, f1 double, lift double, specificity double"
TCF = "concept string, feature_id int, pmi double, count_joint long, f1 double, rank int, tcf double, precision double, recall double, span_recall double, optimal_threshold double"
PURITY = "feature_id int, ast_purity double, total_activation double, count_activations long, count_distinct_ast_types long"
TAXONOMY = "file string, level int, label string, name string, description string, languages array<string>, parent string, depth int, ordinal int"
LANGUAGES = "language string, extension string"
CPG_NODES = "id long, label string, name string, code string, full_name string, method_full_name string, filename string, control_structure_type string, line_number int, column_number int, argument_index int"
CPG_EDGES = "edge_id long, src long, dst long, type string"
PROMPTS = "prompt_type string, system_prompt string, taxonomy string, annotation_instructions string, user_prompt_template string"
