"""Word lists and codes. All values in this file are fixed: results depend on each of them."""

# Legal forms and fillers that are dropped from the end of a company name.
LEGAL = """INC INCORPORATED CORP CORPORATION CO COMPANY COMPANIES LLC LC LP LLP PLLC LTD LIMITED PLC SA SAS SARL NV BV AG
GMBH KG KGAA KK AB OY OYJ SPA SRL AS ASA APS PTE PTY SE CV OG EV TRUST HOLDING HOLDINGS GROUP THE AND OF NEW CL ADR SPON""".split()

# Legal forms alone.
LEGAL_STRICT = """INC INCORPORATED CORP CORPORATION CO COMPANY COMPANIES LLC LC LP LLP PLLC LTD LIMITED PLC SA SAS SARL NV BV AG
GMBH KG KGAA KK AB OY OYJ SPA SRL AS ASA APS OG PTE PTY SE CV EV""".split()

# One suffix of these is dropped by the simple cleaner.
ONE_SUFFIX = "INC CORP CORPORATION LTD LIMITED LLC CO COMPANY PLC HOLDINGS GROUP".split()

# Long and short forms of words in company names.
SHORT_FORMS = {
    "TECHNOLOGIES": "TECH", "TECHNOLOGY": "TECH", "INTERNATIONAL": "INT", "ENTERPRISE": "ENTPR", "ENTERPRISES": "ENTPR",
    "SCIENTIFIC": "SCIENT", "SCIENCES": "SCIENT", "SCIENCE": "SCIENT", "MANUFACTURING": "MFG", "LABORATORY": "LAB",
    "LABORATORIES": "LAB", "LABS": "LAB", "INDUSTRIES": "IND", "INDUSTRIAL": "IND", "ASSOCIATION": "ASS",
    "INSTRUMENTS": "INSTR", "RESEARCH": "RES", "NATIONAL": "NAT", "UNIVERSITY": "UNIV", "DEVELOPMENT": "DEV",
    "GENERAL": "GEN", "SYSTEMS": "SYS", "SYST": "SYS", "ELECTRIC": "ELEC", "EQUIPMENT": "EQUIP", "MACHINES": "MACH",
    "BUSINESS": "BUS", "PRECISION": "PREC", "CHEMICAL": "CHEM", "CHEMICALS": "CHEM", "AMERICA": "AMER", "AMERICAN": "AMER",
}

# Words too common to identify a company alone.
GENERIC = """ORANGE APPLE SHELL GENERAL AMERICAN NATIONAL UNITED FIRST GLOBAL UNIVERSAL PIONEER SUMMIT LIBERTY ALLIANCE CENTURY
PACIFIC ATLANTIC EAGLE PHOENIX APEX VANTAGE SQUARE BLOCK MATCH OPEN NEXT ON V G IAC AS GO UP ARM LINE SONY VISA TARGET GAP NIKE""".split()

# Words of institutions, which are not persons.
INSTITUTIONS = """UNIV UNIVERSITY INST INSTITUTE COLLEGE SCHOOL ACADEMY HOSPITAL CLINIC FOUND FOUNDATION CENTER CENTRE LAB
MUSEUM SOCIETY COUNCIL BOARD AGENCY BUREAU MINISTRY""".split()

# Words that name a unit of the same group when they follow its brand.
FUNCTIONAL = """TECH RES DEV IP LICENSING SOLUTIONS PRODUCTS SERVICES SYS LAB GLOBAL INT ENTPR HOLDING HOLDINGS GROUP DIGITAL
VENTURES INVESTMENTS OPERATIONS MFG ENG DESIGN SOFTWARE NETWORKS SEMICONDUCTOR MICROELECTRONICS INSTR AMERICA AMERICAS NORTH EUROPE
ASIA JAPAN CHINA KOREA USA US UK DEUTSCHLAND FRANCE CANADA INDIA SINGAPORE COM ONLINE INTERACTIVE ENTERTAINMENT MEDIA STUDIOS""".split()

# Thresholds of entity resolution.
GIVEN_FOLLOW, GIVEN_LEGAL, SURNAME_MIN, CORE_MIN = 100, 0.10, 15, 5

# Search terms that decide alone (nW: at most n words between).
K1 = """(artific+|computation+) 1W intelligen+
neural 1W network+
neural_network+
bayes+ 1W network+
bayesian-network+
chatbot?
data 1W mining+
decision 1W model?
deep 1W learning+
deep-learning+
genetic 1W algorithm?
inductive 1W logic 1W programm+
machine 1W learning+
machine-learning+
natural 1W language 1W (generation|processing)
reinforcement 1W learning
supervised 1W (learning+|training)
supervised-learning+
swarm 1W intelligen+
swarm-intelligen+
unsupervised 1W (learning+|training)
unsupervised-learning+
semi-supervised 1W (learning+|training)
semi-supervised-learning+
connectionis#
expert 1W system?
fuzzy 1W logic?
transfer-learning
transfer 1W learning
learning 3W algorithm?
learning 1W model?
support vector machine?
random forest?
decision tree?
gradient tree boosting
xgboost
adaboost
rankboost
logistic regression
stochastic gradient descent
multilayer perceptron?
latent semantic analysis
latent dirichlet allocation
multi-agent system?
hidden markov model?""".splitlines()

# Search terms that count only with a code (nD: in either order).
K2 = """clustering
comput+ creativity
descriptive model?
inductive reasoning
overfitting
predictive 1W (analytics|model?)
target 1W function?
(test|training|validation) 1W data 1W set?
backpropagation?
self-learning
objective function?
feature? selection
embedding?
active learning
regression model?
(stochastic|probabilist+) 2D (approach+|technique?|method?|algorithm?)
recommend+ 0W system?
(text|speech|hand_writing|facial|face?|character?) 1W (analysis|analytic?|recognition)""".splitlines()

# Field labels and their code prefixes; the first that fits holds.
FIELDS = (
    ("neural_network", ("G06N3/",)),
    ("machine_learning", ("G06N20/", "G06N99/", "G06F15/18")),
    ("probabilistic_reasoning", ("G06N7/", "G06N5/")),
    ("computer_vision", ("G06V", "G06K9/", "G06T")),
    ("speech", ("G10L",)),
    ("nlp", ("G06F40/", "G06F17/27", "G06F17/28")),
    ("information_retrieval", ("G06F16/", "G06F17/30")),
    ("control_robotics", ("G05B13/", "G05D1/", "B25J", "B60W")),
    ("bioinformatics_health", ("G16B", "G16C", "G16H", "G06F19/")),
)

# Successors that a withdrawn code may be mapped to.
SUCCESSORS = (
    ("G06K9/", ("G06V", "G06F18/")),
    ("G06F17/30", ("G06F16/",)),
    ("G06F17/27", ("G06F40/",)),
    ("G06F17/28", ("G06F40/",)),
    ("G06N99/", ("G06N20/",)),
    ("G06F15/18", ("G06N20/",)),
    ("G06N7/", ("G06N7/", "G06N20/")),
    ("G06N3/", ("G06N3/",)),
    ("G06N5/", ("G06N5/",)),
    ("G06F19/", ("G16B", "G16C", "G16H")),
    ("G10L13/", ("G10L13/",)),
    ("G10L15/", ("G10L15/",)),
    ("G10L17/", ("G10L17/",)),
)

# Industry codes of technology firms, in both versions.
TECH_PREFIX4_V1 = "3341 3342 3344 3345 5112 5161 5179 5181 5182 5415".split()
TECH_PREFIX4_V2 = "3341 3342 3344 3345".split()
TECH_CODES_V2 = "511210 511200 513210 519130 519190 516210 519290 518111 518210 517911 517919 517810 541511 541512 541513 541519".split()

# Categories whose papers count as AI papers.
AI_CATEGORIES = "cs.LG cs.AI cs.CL cs.CV stat.ML cs.NE".split()

# Concordance thresholds: least share and number of candidates, share from which a successor is adopted.
CONCORDANCE_SHARE, CONCORDANCE_RANKED, CONCORDANCE_MOST, CONCORDANCE_ADOPT = 0.30, 30, 8, 0.50

# Names of the R&D fact in filings, the first that a firm reports is taken.
RD_TAGS = ("ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost", "ResearchAndDevelopmentExpenseSoftwareExcludingAcquiredInProcessCost")

# Paper categories to subfields, and the order of the single label.
SUBFIELD = {"cs.CL": "LLM_NLP", "cs.NE": "Neural_Networks", "cs.CV": "Computer_Vision", "cs.RO": "Robotics", "cs.LG": "Machine_Learning", "stat.ML": "Machine_Learning", "cs.AI": "General_AI"}
SUBFIELD_ORDER = ("cs.CL", "cs.CV", "cs.RO", "cs.LG", "stat.ML", "cs.AI", "cs.NE")
