"""Fixed schemas of the question bank's tables and of the structures in flight (Spark DDL)."""

from __future__ import annotations

QUESTIONS = (
    "id long NOT NULL, dy_ques_id string, dy_code string, ln_code string, dy_order string, dy_pattern string, dy_seconds string, "
    "dy_question string NOT NULL, dy_image_name string, dy_ans_1 string NOT NULL, dy_ans_2 string NOT NULL, dy_ans_3 string NOT NULL, "
    "dy_ans_4 string NOT NULL, dy_correct_ans string NOT NULL, dy_explain string, dy_explain_image_name string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, difficulty string NOT NULL, source_filename string, batch_id string, model string, board string, "
    "standard string, group_name string, subject string"
)
SELECTED = "id long, question_id long NOT NULL, batch_id string, selected_at timestamp_ntz"
QUESTION_COUNTERS = "prefix string NOT NULL, last_number int NOT NULL"
ORDER_COUNTERS = "dy_code string NOT NULL, last_order int NOT NULL"
PUSH_LOG = "dy_ques_id string NOT NULL, exam_type string NOT NULL, live_ques_id string, status string NOT NULL, response_detail string, pushed_at timestamp_ntz"
SUMMARIES = (
    "id long, batch_id string, board string, standard string, subject string, lesson_number string, lesson_name string, language string, "
    "bullets string NOT NULL, difficulty string, source_filename string, start_page int, end_page int, model string, created_at timestamp_ntz"
)
QUESTION = "question string, options map<string,string>, answer string, correct_answer_text string, explanation string, pattern int"
REPLIES = "window_no int, chunk_no int, reply string"
PAGES = "doc string, num int, text string, lines array<string>, header string"
LESSONS = (
    "lesson_id string, lesson_number string, lesson_name string, start_page int, end_page int, "
    "subsections array<struct<code:string,title:string>>, text string"
)
JOB_UPDATES = "job_id string, status string, delivered_count int, requested_count int, error string, updated_at timestamp"
PUSH_RESULTS = "dy_ques_id string, live_ques_id string, ok boolean, detail string"
UPLOAD_KEYS = ("dy_ques_id", "dy_code", "ln_code", "dy_order", "dy_pattern", "dy_seconds", "dy_question", "dy_ans_1", "dy_ans_2", "dy_ans_3", "dy_ans_4", "dy_correct_ans", "dy_explain")
TABLES = {
    "questions": QUESTIONS, "selected_questions": SELECTED, "subject_ques_counters": QUESTION_COUNTERS,
    "exam_order_counters": ORDER_COUNTERS, "live_push_log": PUSH_LOG, "summaries": SUMMARIES,
}
#: Columns of older tables and their present names.
RENAMED = {"ques_id": "dy_ques_id", "question": "dy_question", "correct_ans": "dy_correct_ans", "explanation": "dy_explain", "pattern": "dy_pattern"}
