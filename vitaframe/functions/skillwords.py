"""Fixed values of skill normalisation: the dictionary and the category hints."""

# Fixed values: (key, canonical name, category, other spellings), in dictionary order.
SKILL_DICTIONARY = (
    # programming languages
    ("python", "Python", "programming", ("python3", "py", "python 3", "python3.x")),
    ("javascript", "JavaScript", "programming", ("js", "java script", "javascript es6", "es6", "node.js backend")),
    ("typescript", "TypeScript", "programming", ("ts", "type script")),
    ("java", "Java", "programming", ("java 8", "java 11", "java 17", "jdk")),
    ("csharp", "C#", "programming", ("c sharp", "c#", ".net", "dotnet")),
    ("cplusplus", "C++", "programming", ("c++", "cpp", "c plus plus")),
    ("go", "Go", "programming", ("golang", "go lang")),
    ("rust", "Rust", "programming", ("rust lang",)),
    ("php", "PHP", "programming", ("php7", "php8")),
    ("ruby", "Ruby", "programming", ("ruby on rails",)),
    # frameworks
    ("react", "React", "frameworks", ("reactjs", "react.js", "react js")),
    ("angular", "Angular", "frameworks", ("angularjs", "angular js", "angular 2+")),
    ("vue", "Vue.js", "frameworks", ("vuejs", "vue js", "vue")),
    ("nextjs", "Next.js", "frameworks", ("next", "nextjs", "next js")),
    ("django", "Django", "frameworks", ("django rest framework", "drf")),
    ("flask", "Flask", "frameworks", ()),
    ("fastapi", "FastAPI", "frameworks", ("fast api",)),
    ("express", "Express.js", "frameworks", ("expressjs", "express js")),
    ("spring", "Spring Framework", "frameworks", ("spring boot", "spring mvc")),
    # databases
    ("postgresql", "PostgreSQL", "databases", ("postgres", "psql", "pg")),
    ("mysql", "MySQL", "databases", ("my sql",)),
    ("mongodb", "MongoDB", "databases", ("mongo db", "mongo")),
    ("redis", "Redis", "databases", ()),
    ("sqlite", "SQLite", "databases", ("sql lite",)),
    ("sql", "SQL", "databases", ("structured query language",)),
    # cloud and containers
    ("aws", "Amazon Web Services", "cloud", ("amazon web services", "aws cloud")),
    ("azure", "Microsoft Azure", "cloud", ("azure cloud", "ms azure")),
    ("gcp", "Google Cloud Platform", "cloud", ("google cloud", "google cloud platform", "gcloud")),
    ("docker", "Docker", "tools", ("containerization",)),
    ("kubernetes", "Kubernetes", "cloud", ("k8s", "kube")),
    # tools
    ("git", "Git", "tools", ("version control", "git version control")),
    ("github", "GitHub", "tools", ("git hub",)),
    ("gitlab", "GitLab", "tools", ("git lab",)),
    ("jenkins", "Jenkins", "tools", ("ci/cd",)),
    ("jira", "Jira", "tools", ("atlassian jira",)),
    # machine learning
    ("tensorflow", "TensorFlow", "technical", ("tensor flow", "tf")),
    ("pytorch", "PyTorch", "technical", ("torch",)),
    ("pandas", "Pandas", "technical", ()),
    ("numpy", "NumPy", "technical", ("num py",)),
    ("scikitlearn", "Scikit-learn", "technical", ("sklearn", "scikit learn")),
    # operating systems
    ("linux", "Linux", "technical", ("unix", "ubuntu", "centos", "red hat")),
    ("windows", "Windows", "technical", ("microsoft windows", "windows server")),
    ("macos", "macOS", "technical", ("mac os", "osx", "os x")),
    # soft skills
    ("leadership", "Leadership", "soft_skills", ("team leadership", "leading teams")),
    ("communication", "Communication", "soft_skills", ("verbal communication", "written communication")),
    ("project_management", "Project Management", "soft_skills", ("project mgmt", "pm")),
    ("problem_solving", "Problem Solving", "soft_skills", ("problem-solving", "troubleshooting")),
)

SKILL_CATEGORIES = (
    "technical", "programming", "frameworks", "databases", "cloud",
    "tools", "languages", "soft_skills", "certifications", "other",
)

# Patterns on the lower-case cleaned name, first category that matches.
CATEGORY_PATTERNS = (
    ("programming", (r"\b(lang|language)$", r"^(c|r|matlab|scala|kotlin|swift|perl|shell)$", r"script$")),
    ("frameworks", (r"(framework|js|\.js)$", r"^(spring|hibernate|laravel|rails|ember|backbone)$")),
    ("databases", (r"(db|database|sql|nosql)$", r"^(oracle|cassandra|neo4j|influx|elastic)$")),
    ("cloud", (r"(cloud|aws|azure|gcp)$", r"^(serverless|lambda|functions)$")),
    ("tools", (r"^(ide|editor|vim|vscode|intellij|eclipse)$", r"(testing|test|ci|cd|devops)$")),
    ("soft_skills", (r"^(teamwork|collaboration|analytical|creative)$", r"(management|planning|organization)$")),
    ("certifications", (r"(certified|certification|cert)$", r"^(pmp|cissp|cism|aws|azure|google).*cert")),
)
TECHNICAL_WORDS = ("api", "rest", "http", "json", "xml", "web", "mobile", "algorithm")

# Words cut off a raw skill name.
NAME_PREFIXES = r"^(?:proficient in|experience with|knowledge of)\s+"
NAME_SUFFIXES = r"\s+(?:programming|development|framework|library|database)$"
