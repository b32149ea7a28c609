"""The built-in pack templates and form presets.

Facts are (key, type, value or values); rules are (priority, instruction).
"""

TEMPLATES = {
    "developer": ("development", "General-purpose development context — languages, frameworks, coding style.", [
        ("languages.primary", "skill", ["Python", "TypeScript"]),
        ("languages.learning", "skill", ["Rust"]),
        ("frameworks", "skill", ["Next.js", "FastAPI"]),
        ("editor", "preference", "VS Code / Cursor"),
        ("style.comments", "style", "Minimal — only for non-obvious logic"),
        ("style.formatting", "style", "Prefer explicit types over inference"),
        ("testing", "preference", "Integration tests over unit tests when possible"),
    ], [
        (8, "Always use strict TypeScript (no 'any')"),
        (5, "Prefer functional patterns over OOP where reasonable"),
        (6, "Use descriptive variable names — no single letters except in loops"),
        (7, "Add error handling with specific error types, not generic catches"),
    ]),
    "writer": ("writing", "Your writing style and content preferences.", [
        ("tone", "style", "Direct, no fluff, occasional sharp humor"),
        ("audience", "context", "Technical professionals"),
        ("formatting", "style", "Short paragraphs, concrete examples, minimal headers"),
        ("languages", "skill", ["English", "French"]),
    ], [
        (8, "Avoid corporate jargon and buzzwords"),
        (6, "Use active voice"),
        (7, "Lead with the conclusion, then explain"),
        (5, "Keep paragraphs under 4 sentences"),
    ]),
    "researcher": ("research", "Research interests and methodology preferences.", [
        ("domains", "context", ["AI/ML", "distributed systems"]),
        ("methodology", "style", "Evidence-based, prefer primary sources"),
        ("citation_style", "preference", "Inline with links"),
    ], [
        (8, "Always cite sources with links when available"),
        (9, "Distinguish between established facts and speculation"),
        (6, "Present contrarian viewpoints alongside mainstream ones"),
    ]),
    "work": ("work", "Professional context — role, company, communication style.", [
        ("role", "identity", "Software Engineer"),
        ("company", "identity", "Acme Corp"),
        ("team", "context", "Platform team"),
        ("communication.style", "style", "Concise, data-driven"),
    ], [
        (7, "Frame recommendations with business impact"),
        (5, "Include time estimates for technical suggestions"),
    ]),
    "frontend": ("development", "Frontend development — React/Next.js, TypeScript, Tailwind, modern web stack.", [
        ("languages.primary", "skill", ["TypeScript", "JavaScript"]),
        ("frameworks", "skill", ["Next.js", "React", "Tailwind CSS", "Vite"]),
        ("editor", "preference", "Cursor"),
        ("style.design", "style", "Mobile-first, dark themes, minimal UI"),
        ("state_management", "preference", "React Server Components when possible, Zustand for client state"),
        ("testing", "preference", "Playwright for E2E, Vitest for unit"),
    ], [
        (9, "Always use TypeScript strict mode — no 'any', no implicit returns"),
        (8, "Use Tailwind utility classes only — no custom CSS unless unavoidable"),
        (8, "Prefer Server Components by default, use 'use client' only when needed"),
        (7, "Mobile-first responsive design — start from smallest viewport"),
        (7, "Accessibility first — semantic HTML, ARIA labels, keyboard navigation"),
        (6, "Dark theme by default — use CSS variables for all colors"),
    ]),
    "backend": ("development", "Backend development — APIs, databases, infrastructure, Python or Node.", [
        ("languages.primary", "skill", ["Python", "TypeScript"]),
        ("frameworks", "skill", ["FastAPI", "SQLAlchemy", "Pydantic"]),
        ("databases", "skill", ["PostgreSQL", "Redis"]),
        ("infrastructure", "skill", ["Docker", "GitHub Actions"]),
        ("api_style", "preference", "REST with OpenAPI spec, considering GraphQL for complex queries"),
    ], [
        (9, "Always validate input with Pydantic models or Zod schemas — never trust raw input"),
        (8, "Write database migrations for every schema change — no manual ALTER TABLE"),
        (8, "Every endpoint needs error handling with proper HTTP status codes"),
        (7, "Log at structured levels (info, warning, error) — no print() in production"),
        (6, "Write integration tests against a real database, not mocks"),
    ]),
    "data-scientist": ("analysis", "Data science, ML, and analytics — Python, notebooks, visualization.", [
        ("languages.primary", "skill", ["Python", "SQL"]),
        ("tools", "skill", ["pandas", "NumPy", "scikit-learn", "Jupyter", "matplotlib"]),
        ("ml_frameworks", "skill", ["PyTorch", "Hugging Face Transformers"]),
        ("visualization", "preference", ["matplotlib", "seaborn", "Plotly"]),
        ("data_sources", "context", ["PostgreSQL", "CSV/Parquet", "REST APIs"]),
    ], [
        (10, "Always cite data sources — never invent numbers or statistics"),
        (9, "Flag assumptions and confidence levels in every analysis"),
        (8, "Prefer charts over tables — explain what the data means, not just what it shows"),
        (8, "Reproducibility matters — include random seeds, version pins, and data checksums"),
        (7, "Start with simple models before reaching for deep learning"),
        (6, "Show your work — include intermediate steps, not just final results"),
    ]),
    "mobile": ("development", "Mobile development — React Native, Swift, Flutter, cross-platform apps.", [
        ("languages.primary", "skill", ["TypeScript", "Swift"]),
        ("frameworks", "skill", ["React Native", "Expo"]),
        ("platforms", "context", ["iOS", "Android"]),
        ("tools", "preference", ["Xcode", "Android Studio", "Flipper"]),
        ("state_management", "preference", "Zustand or React Query for server state"),
    ], [
        (9, "Always handle offline state — assume the network is unreliable"),
        (8, "Test on real devices, not just simulators"),
        (8, "Respect platform conventions — iOS Human Interface Guidelines, Material Design"),
        (7, "Performance first — no unnecessary re-renders, lazy load heavy screens"),
        (7, "Accessibility from day one — VoiceOver, TalkBack, dynamic font sizes"),
    ]),
    "devops": ("infrastructure", "DevOps and SRE — CI/CD, containers, cloud, monitoring, reliability.", [
        ("languages.primary", "skill", ["Python", "Bash", "Go"]),
        ("tools", "skill", ["Docker", "Kubernetes", "Terraform", "GitHub Actions"]),
        ("cloud", "skill", ["AWS", "GCP"]),
        ("monitoring", "preference", ["Prometheus", "Grafana", "Datadog"]),
        ("methodology", "style", "Infrastructure as Code, GitOps, immutable deployments"),
    ], [
        (10, "Everything as code — no manual infrastructure changes, ever"),
        (9, "Every deployment must be reversible — rollback plan before shipping"),
        (8, "Alerts must be actionable — no alert fatigue, no noisy dashboards"),
        (8, "Least privilege by default — no admin credentials in scripts or env vars"),
        (7, "Document runbooks for every critical service — assume you're on-call at 3 AM"),
    ]),
    "founder": ("product", "Indie hacker / founder — product thinking, speed, MVP mindset.", [
        ("role", "identity", "Solo founder building an MVP"),
        ("stack", "skill", ["Python", "Next.js", "Supabase", "Vercel"]),
        ("tools", "preference", ["Cursor", "Claude", "ChatGPT", "Linear"]),
        ("stage", "context", "Pre-launch, iterating fast, seeking product-market fit"),
        ("constraints", "constraint", "Solo dev, limited budget, time is the bottleneck"),
    ], [
        (10, "Always think MVP — ship the smallest thing that tests the hypothesis"),
        (9, "User value over code quality — working > perfect"),
        (8, "Give me the fastest path, not the most elegant one"),
        (7, "When suggesting tools or services, prefer free tiers and open source"),
        (7, "Challenge my assumptions — tell me when an idea won't work"),
    ]),
    "student": ("education", "Student / learner — studying, building projects, learning new skills.", [
        ("role", "identity", "CS student learning to build real projects"),
        ("languages.learning", "skill", ["Python", "JavaScript"]),
        ("interests", "context", ["AI/ML", "web development", "open source"]),
        ("level", "context", "Intermediate — understands basics, building toward advanced"),
    ], [
        (9, "Explain concepts step by step — don't skip fundamentals"),
        (9, "Always explain WHY, not just HOW — I want to understand the reasoning"),
        (8, "When showing code, include comments explaining non-obvious parts"),
        (7, "Suggest projects or exercises to practice new concepts"),
        (6, "Point me to official docs and good learning resources when relevant"),
        (8, "Don't do my homework — guide me to the answer instead"),
    ]),
    "marketer": ("marketing", "Content marketer / growth — copywriting, SEO, social media, analytics.", [
        ("role", "identity", "Content marketer focused on growth"),
        ("channels", "context", ["Twitter/X", "LinkedIn", "Blog", "Newsletter"]),
        ("tools", "preference", ["Google Analytics", "Ahrefs", "Notion", "Canva"]),
        ("tone", "style", "Conversational, punchy, data-backed"),
        ("audience", "context", "Technical professionals and early adopters"),
    ], [
        (9, "Lead with a hook — first line must stop the scroll"),
        (8, "Back claims with numbers — no vague statements"),
        (8, "Write at an 8th-grade reading level — simple beats clever"),
        (7, "Every piece of content needs a clear CTA"),
        (6, "SEO matters — include keywords naturally, don't stuff them"),
    ]),
    "designer": ("design", "Product designer / UX — user research, wireframes, design systems.", [
        ("role", "identity", "Product designer"),
        ("tools", "preference", ["Figma", "Framer", "Storybook"]),
        ("methodology", "style", "User-centered design, iterative prototyping"),
        ("focus", "context", "Design systems, interaction design, accessibility"),
    ], [
        (9, "Always start with the user problem, not the solution"),
        (9, "Accessibility is not optional — WCAG 2.1 AA minimum"),
        (7, "When suggesting UI patterns, reference existing design systems (Radix, shadcn)"),
        (7, "Mobile-first wireframes before desktop"),
        (6, "Less is more — remove before adding"),
    ]),
    "ai-builder": ("development", "AI/LLM builder — agents, RAG, fine-tuning, prompt engineering, tooling.", [
        ("languages.primary", "skill", ["Python", "TypeScript"]),
        ("frameworks", "skill", ["LangChain", "LlamaIndex", "Hugging Face", "OpenAI SDK"]),
        ("tools", "preference", ["Ollama", "vLLM", "Claude API", "OpenAI API"]),
        ("focus", "context", "RAG pipelines, agent systems, MCP servers, prompt optimization"),
        ("models", "context", ["Claude", "GPT-4", "Llama", "Mistral"]),
    ], [
        (9, "Always consider token cost and latency — efficiency matters at scale"),
        (8, "Prefer structured outputs (JSON, XML) over free-text when parsing LLM responses"),
        (8, "Always add retry logic and fallbacks for API calls — LLMs fail"),
        (8, "Eval before shipping — no prompt change without measuring impact"),
        (7, "RAG over fine-tuning unless you have a clear reason to fine-tune"),
        (7, "Show me the prompt — never hide the system prompt in abstractions"),
    ]),
}

# Form answer "tone": preset number -> (tone, rules)
TONES = {
    "1": ("Direct, no fluff, sharp analytical edge. Challenge me when my reasoning has gaps.", [
        (9, "Avoid corporate jargon, buzzwords, and empty filler phrases"),
        (8, "Lead with the conclusion, then explain the reasoning"),
        (9, "Challenge me directly when my reasoning has gaps — no sugarcoating"),
    ]),
    "2": ("Friendly, supportive, encouraging. Explain things clearly with patience.", [
        (7, "Be encouraging and supportive in tone"),
        (8, "Explain complex concepts step by step"),
        (6, "Offer alternatives when suggesting changes"),
    ]),
    "3": ("Technical, precise, detailed. Assume I know what I'm doing.", [
        (9, "Be technically precise — use correct terminology"),
        (8, "Skip beginner explanations unless asked"),
        (7, "Include edge cases and caveats in technical answers"),
    ]),
}
