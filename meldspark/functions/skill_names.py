"""The built-in vocabulary."""

# Skill names and their aliases.
SKILLS = {
    "Python": ["py", "python3", "python programming"],
    "JavaScript": ["js", "javascript", "java script", "ecmascript"],
    "TypeScript": ["ts", "type script"],
    "Java": ["jdk", "java se"],
    "Go": ["golang", "go lang"],
    "Rust": ["rust-lang", "rustlang"],
    "C++": ["cpp", "cplusplus", "c plus plus"],
    "C#": ["csharp", "c sharp", "dotnet", ".net"],
    "SQL": ["structured query language"],
    "PostgreSQL": ["postgres", "postgre sql", "psql", "postgresql"],
    "MySQL": ["my sql"],
    "MongoDB": ["mongo"],
    "Redis": [],
    "SQLite": ["sqlite3"],
    "HTML": ["html5"],
    "CSS": ["css3"],
    "Tailwind CSS": ["tailwind", "tailwindcss"],
    "React": ["react.js", "reactjs", "react js"],
    "Next.js": ["nextjs", "next js"],
    "Node.js": ["node", "nodejs", "node js"],
    "Express": ["express.js", "expressjs"],
    "Vue.js": ["vue", "vuejs"],
    "Angular": ["angular.js", "angularjs"],
    "Flutter": [],
    "Dart": [],
    "Kotlin": [],
    "Swift": [],
    "PHP": [],
    "Ruby": [],
    "Ruby on Rails": ["rails", "ror"],
    "Django": [],
    "Flask": [],
    "FastAPI": ["fast api"],
    "Spring Boot": ["springboot", "spring"],
    "Docker": ["docker engine", "dockerized"],
    "Kubernetes": ["k8s", "kube"],
    "Terraform": ["tf", "hashicorp terraform"],
    "Ansible": [],
    "AWS": ["amazon web services"],
    "Azure": ["microsoft azure"],
    "GCP": ["google cloud", "google cloud platform"],
    "Git": [],
    "GitHub": ["git hub"],
    "GitLab": [],
    "Firebase": [],
    "Supabase": [],
    "Vercel": [],
    "Netlify": [],
    "Postman": [],
    "GraphQL": ["graph ql"],
    "REST API": ["rest", "restful", "rest apis", "restful api"],
    "Pandas": [],
    "NumPy": ["numpy"],
    "TensorFlow": ["tensor flow"],
    "PyTorch": ["torch"],
    "scikit-learn": ["sklearn", "scikit learn"],
    "LangChain": ["lang chain"],
    "Snowflake": [],
    "Kafka": ["apache kafka"],
    "Spark": ["apache spark"],
    "Linux": [],
    "Bash": ["shell", "shell scripting"],
}
