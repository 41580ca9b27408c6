"""Texts of made-up corpus rows. ``{name}`` marks a value filled in per row."""

# Fixed values, in their natural order: (file name, content) per label.
SYNTHETIC_TEMPLATES = {
    "Code": [
        (
            "api_handler_{index}.py",
            "def fetch_user(user_id):\n"
            "    query = 'SELECT id, email FROM users WHERE id = %s'\n"
            "    return db.execute(query, (user_id,))\n"
            "class UserService:\n"
            "    def validate_token(self, token):\n"
            "        return token.startswith('sk_')\n",
        ),
        (
            "frontend_widget_{index}.js",
            "export function renderWidget(items) {\n"
            "  return items.map((item) => `<li>${item.name}</li>`).join('');\n"
            "}\n"
            "const state = { loading: false, page: 1 };\n",
        ),
        (
            "migration_{index}.sql",
            "CREATE TABLE invoices (\n"
            "    id INTEGER PRIMARY KEY,\n"
            "    customer_name TEXT,\n"
            "    total_amount DECIMAL(10, 2)\n"
            ");\n"
            "CREATE INDEX idx_invoices_customer ON invoices(customer_name);\n",
        ),
        (
            "engine_core_{index}.cpp",
            "#include <vector>\n"
            "#include <string>\n"
            "int compute_checksum(const std::vector<int>& values) {\n"
            "    int result = 0;\n"
            "    for (int value : values) { result ^= value; }\n"
            "    return result;\n"
            "}\n",
        ),
    ],
    "Docs": [
        (
            "meeting_notes_{index}.txt",
            "Meeting notes: reviewed release scope, assigned QA owners, "
            "documented deployment risks, and scheduled follow-up with platform team.",
        ),
        (
            "technical_spec_{index}.md",
            "Technical specification for the ingestion service. The module exposes REST endpoints, "
            "stores audit events, and retries failed deliveries with exponential backoff.",
        ),
        (
            "user_manual_{index}.docx",
            "User manual draft describing login flow, navigation sidebar, search filters, "
            "troubleshooting steps, and administrator permissions.",
        ),
        (
            "architecture_overview_{index}.pdf",
            "System overview with service boundaries, API contracts, integration sequence, "
            "dependency notes, and acceptance criteria for the current milestone.",
        ),
    ],
    "Finance": [
        (
            "invoice_{month}_{index}.pdf",
            "Invoice number INV-{index4}. Customer amount due {amount}.00 USD. "
            "Subtotal {subtotal}.00 USD. Tax {tax} USD. Payment due within 10 business days.",
        ),
        (
            "salary_slip_{month}_{index}.xlsx",
            "Payroll statement for employee {index}. Base salary {amount}.00 RUB. "
            "Bonus 5000.00 RUB. Income tax {tax} RUB. Net pay {net} RUB.",
        ),
        (
            "budget_report_q{quarter}_{index}.csv",
            "Budget allocation table. Marketing {amount}. Operations {half}. "
            "Forecast variance 4.5 percent. Approved by finance controller.",
        ),
    ],
    "Study": [
        (
            "lecture_ml_week_{index}.pdf",
            "Lecture notes on gradient descent, loss minimization, matrix derivatives, "
            "regularization, and overfitting. Formula: J(theta) = 1/m * sum((h(x)-y)^2).",
        ),
        (
            "homework_algebra_{index}.docx",
            "Homework assignment: solve linear systems, compute determinants, prove theorem, "
            "and derive eigenvalues for the provided matrices.",
        ),
        (
            "exam_prep_physics_{index}.txt",
            "Study guide covering Newton laws, impulse conservation, oscillations, "
            "laboratory questions, and sample derivations for final exam preparation.",
        ),
    ],
    "Media": [("{stem}_{index}.{suffix}", "")],
    "Archives": [("{stem}_{index}.{suffix}", "")],
    "Logs": [
        (
            "service_{index}.log",
            "2026-03-{day2} 10:{minute}:{second} {status} request_id=req-{index5} "
            "ip=192.168.{octet3}.{octet4} endpoint={endpoint} latency_ms={latency} "
            "message=background worker processed event batch {index}.",
        )
    ],
    "Other": [("unknown_item_{index}.{suffix}", "{phrase}")],
}

# What the list-valued placeholders above are drawn from.
SYNTHETIC_CHOICES = {
    "Finance": {"month": ["jan", "feb", "mar", "apr", "may", "jun"]},
    "Media": {
        "suffix": ["jpg", "png", "mp4", "mp3", "gif", "wav", "mkv"],
        "stem": ["vacation_clip", "podcast_episode", "thumbnail", "camera_roll", "screen_capture"],
    },
    "Archives": {
        "suffix": ["zip", "rar", "7z", "tar", "tar.gz"],
        "stem": ["backup_bundle", "project_snapshot", "release_build", "logs_archive", "assets_package"],
    },
    "Logs": {
        "status": ["INFO", "WARN", "ERROR"],
        "endpoint": ["/api/login", "/api/files", "/health", "/billing/charge"],
    },
    "Other": {
        "phrase": [
            "lorem zqxv packet amber flux nine",
            "tmp raw object delta noodle frame",
            "unsorted bundle item alpha beta gamma",
            "draft final final maybe keep this one",
        ],
        "suffix": ["bin", "dat", "tmp", "bak", "blob", "misc"],
    },
}

# Inclusive ranges of the number-valued placeholders above.
SYNTHETIC_RANGES = {
    "Finance": {"amount": (1200, 25000), "quarter": (1, 4)},
    "Logs": {
        "octet3": (10, 240),
        "day": (1, 28),
        "minute": (10, 59),
        "second": (10, 59),
        "octet4": (1, 254),
        "latency": (12, 980),
    },
}

# The seed corpus, three labels; lists are indexed by row number modulo their length.
SEED_TEMPLATES = {
    "Docs": ("{name}_{index}.txt", "Текстовый документ по теме: {subject}. {action}. {ending}"),
    "Finance": (
        "{name}_{index}.txt",
        "{title} №{number} от 08.04.2026. Контрагент: {vendor}. Подразделение: {department}. "
        "Назначение платежа: {purpose}. Сумма к оплате {amount} руб., НДС {vat} руб., "
        "срок оплаты 5 банковских дней.",
    ),
    "Study": (
        "{name}_{index}.txt",
        "Учебный материал по теме: {topic}. {task} "
        "Используются понятия матрицы, производная, эксперимент, модель и вычисления.",
    ),
}

SEED_CHOICES = {
    "Docs": {
        "name": [
            "служебная_записка",
            "новости_отдела",
            "план_проекта",
            "протокол_встречи",
            "заметки_команды",
            "описание_процесса",
        ],
        "subject": [
            "запуск нового сервиса",
            "обновление внутреннего регламента",
            "подготовка презентации для партнеров",
            "обсуждение сроков релиза",
            "согласование требований по проекту",
            "изменение графика тестирования",
        ],
        "action": [
            "команда согласовала список задач и ответственных",
            "в документ внесли замечания по качеству и срокам",
            "руководитель попросил обновить описание этапов работ",
            "участники встречи зафиксировали риски и дальнейшие шаги",
            "в тексте указаны основные выводы и рекомендации",
        ],
        "ending": [
            "Материал подготовлен для внутреннего использования и обсуждения.",
            "Документ нужен для координации команды и планирования следующих задач.",
            "Файл содержит общую информацию без финансовой отчетности и формул.",
        ],
    },
    "Finance": {
        "name": ["счет", "акт", "накладная", "платежное_поручение", "отчет_по_бюджету", "ведомость"],
        "department": [
            "отдел закупок",
            "финансовый департамент",
            "бухгалтерия",
            "коммерческий отдел",
        ],
        "vendor": ["ООО Альфа", "ООО Вектор", "АО Спектр", "ИП Соколова"],
        "purpose": [
            "оплата поставки оборудования",
            "закрытие услуг по сопровождению",
            "перечисление аванса по договору",
            "подтверждение выполнения работ",
        ],
    },
    "Study": {
        "name": [
            "лекция_нейросети",
            "конспект_линейная_алгебра",
            "лабораторная_физика",
            "методичка_матанализ",
            "семинар_машинное_обучение",
            "курсовая_черновик",
        ],
        "topic": [
            "градиентный спуск и функция потерь",
            "собственные значения и векторы",
            "метод наименьших квадратов",
            "переобучение и регуляризация",
            "обратное распространение ошибки",
            "классификация текстов и TF-IDF признаки",
        ],
        "task": [
            "В тексте объясняются основные определения, формулы и примеры решения задач.",
            "Материал подготовлен для экзамена и содержит теоретические выводы.",
            "Документ описывает лабораторную работу, цель исследования и порядок расчета.",
            "В заметках есть ссылки на лекцию, домашнее задание и рекомендуемую литературу.",
        ],
    },
}

SEED_ROWS_PER_LABEL = 180
