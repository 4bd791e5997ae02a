"""Word lists and curated values that results depend on, in their natural order."""

# Patterns of immunoglobulin names (searched anywhere, case ignored)
IMMUNOGLOBULIN = (
    r"ighv|iglv|igkv|heavy chain variable|light chain variable|igh\b|igl\b|igk\b|immunoglobulin|\big\b|clone|clonotype|\bcdr\b"
    r"|_heavy_|_light_|ighg|igha|ighm|ighe|iglc|igkc|heavy chain constant|light chain constant|10e8"
)

# Words that look like gene symbols at the start of a name but are none
NOT_A_LEADING_SYMBOL = ("EC", "DNA", "RNA", "ATP", "ADP", "GTP", "NAD", "MHC", "HLA", "ABC", "BAG", "BET", "LOW")

# The same for words in parentheses
NOT_A_BRACKETED_SYMBOL = ("EC", "CD", "IG")

# Categories of protein names and their key words; the first category that matches wins
CATEGORIES = (
    ("Complement", ("complement", "c1q", "c1r", "c1s", "c4b-binding", "factor b", "factor h", "factor i", "c2 ", "c3 ", "c4 ", "c5 ")),
    ("Apolipoprotein", ("apolipoprotein", "apoa", "apob", "apoc", "apod", "apoe", "apol", "apom", "clusterin")),
    ("Enzyme", ("ec ",)),
    ("Protease Inhibitor", ("serpin", "inhibitor", "alpha-2-macroglobulin", "antithrombin", "cystatin")),
    ("Coagulation", ("fibrinogen", "coagulation", "prothrombin", "plasminogen", "factor v", "factor ix", "factor x", "von willebrand")),
    ("Plasma Abundant", ("albumin", "transthyretin", "transferrin", "haptoglobin", "hemopexin", "alpha-2-hs", "fetuin", "ceruloplasmin")),
    ("Cytokine/GF", ("chemokine", "interleukin", "cytokine", "growth factor", "igfbp", "tumor necrosis")),
    ("Kinase/Phosphatase", ("kinase", "phosphatase", "akap")),
    ("Receptor", ("receptor", "glutamate")),
    ("Neural/Brain", ("neural", "neuro", "brain", "synap", "secretogranin", "chromogranin", "kinesin")),
    ("ECM/Adhesion", ("cadherin", "collagen", "laminin", "fibulin", "fibronectin", "extracellular matrix")),
)

# Key words of known disease biology
DISEASE_KEYWORDS = (
    "alzheimer", "amyloid", "tau", "neurodegeneration", "complement", "lipid", "cholesterol", "apolipoprotein", "neuroinflammation",
    "synapse", "synaptic", "autophagy", "lysosome", "endocytosis", "apoptosis", "oxidative stress", "mitochondri", "immune",
    "coagulation", "insulin", "calcium", "neurotransmitter",
)

# Curated disease scores, used where fewer than 10 genes have one
CURATED_DISEASE_SCORES = {
    "APOE": 0.95, "CLU": 0.85, "BIN1": 0.80, "PICALM": 0.75, "CR1": 0.70, "ABCA7": 0.70, "TREM2": 0.80, "SORL1": 0.75,
    "APP": 0.95, "MAPT": 0.90, "PSEN1": 0.90, "PSEN2": 0.85, "BACE1": 0.80, "BACE2": 0.60,
    "CST3": 0.65, "TTR": 0.60, "GSN": 0.55, "SERPINA3": 0.60, "CHI3L1": 0.65, "NRGN": 0.70, "NEFL": 0.75,
    "C1QA": 0.60, "C1QB": 0.60, "C1QC": 0.60, "C2": 0.50, "C3": 0.65, "C4A": 0.55, "C4B": 0.55,
    "CFH": 0.55, "CFI": 0.50, "CFB": 0.50, "C5": 0.50,
    "APOA1": 0.50, "APOA4": 0.40, "APOB": 0.40, "APOC1": 0.50, "APOC3": 0.45, "APOD": 0.55, "APOM": 0.40, "APOL1": 0.40,
    "CRP": 0.55, "SAA1": 0.50, "SAA2": 0.45, "SERPINA1": 0.50, "SERPINF2": 0.40,
    "FGA": 0.40, "FGB": 0.40, "FGG": 0.40, "PLG": 0.35,
    "SYN1": 0.60, "SYP": 0.55, "SNAP25": 0.60, "STX1A": 0.55,
    "ALB": 0.20, "TF": 0.30, "HP": 0.35, "HPX": 0.30,
}

# Curated interaction centralities, for weighting experiments
CURATED_CENTRALITIES = {
    "ALB": 0.95, "APOE": 0.90, "APP": 0.88, "TP53": 0.85, "EGFR": 0.82, "AKT1": 0.80, "MAPT": 0.78, "PSEN1": 0.75, "CLU": 0.70, "TREM2": 0.68,
    "C3": 0.65, "CFH": 0.60, "FN1": 0.60, "VTN": 0.58, "APOA1": 0.55, "HPX": 0.52, "HP": 0.50, "TF": 0.48, "TTR": 0.45, "CST3": 0.42,
    "NEFL": 0.40, "SNAP25": 0.38, "SYN1": 0.35, "CHI3L1": 0.33, "NRGN": 0.30, "SERPINA1": 0.28, "CRP": 0.25, "PLG": 0.22,
    "FGA": 0.20, "FGB": 0.20, "FGG": 0.20, "BIN1": 0.18, "PSEN2": 0.22, "BACE1": 0.18, "SORL1": 0.16, "ABCA7": 0.14,
}
