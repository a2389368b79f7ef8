"""Fixed values that must equal the analysed application's for identical results.

Everything in this module is data, stated plainly and in natural order:
horizon tables, prompt templates, messages and thresholds. Templates use
``{name}`` placeholders that ``pricelab.functions.text.render`` turns into a
Spark ``concat`` (and ``render_sql`` into a DuckDB ``||`` chain).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES -- horizon tables (prediction days -> context rows)
# ---------------------------------------------------------------------------
# Serving / backtest table (6 rows).
SERVING_HORIZONS = [
    (1, 30),
    (5, 60),
    (7, 90),
    (10, 180),
    (30, 365),
    (90, 1000),
]
# Corpus table (7 rows: the serving table plus 365 -> 1825).
CORPUS_HORIZONS = SERVING_HORIZONS + [(365, 1825)]

# Fallback when the requested horizon exceeds every table entry.
FALLBACK_CONTEXT_DAYS = 1000

# ---------------------------------------------------------------------------
# FIXED VALUES -- thresholds and sizes
# ---------------------------------------------------------------------------
MIN_PREDICTION_DAYS = 1
MAX_PREDICTION_DAYS = 90
MA_WINDOW = 20
TRADING_DAYS_PER_YEAR = 252
MIN_ROWS_FOR_VOLATILITY = 50
NUM_VOLATILE = 8
NUM_STABLE = 7
CHUNK_SIZE = 180
CHUNK_OVERLAP = 30
FINAL_CONTEXT_ROWS = 180
STABILITY_THRESHOLD_PCT = 5.0
JUMP_LOW = 0.5
JUMP_HIGH = 2.0
MAX_CONTEXT_DAYS_FILTER = 1000
NEWS_LOOKBACK_DAYS = 5
NEWS_CAP = 20
CORPUS_NEWS_LOOKBACK_DAYS = 30
CORPUS_NEWS_CAP = 100
ONE_SHOT_CONTEXT = 60
EVAL_FRACTION = 0.05
EVAL_CAP = 10000
SPLIT_SEED = 42
VOLATILITY_TO_ARTICLE_COUNT = [("low", 10), ("medium", 25), ("high", 50)]
VOLATILE_DAY_QUOTA = 50
CALM_DAY_QUOTA = 10

# Vendor period tokens and their length in months.
PERIOD_MONTHS = [
    ("1mo", 1),
    ("2mo", 2),
    ("3mo", 3),
    ("6mo", 6),
    ("1y", 12),
    ("2y", 24),
    ("3y", 36),
    ("5y", 60),
]
# Context rows -> period token (upper bounds, first match wins; else "5y").
PERIOD_BY_CONTEXT = [
    (30, "1mo"),
    (60, "2mo"),
    (90, "3mo"),
    (180, "6mo"),
    (365, "1y"),
    (1000, "3y"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES -- messages and default texts
# ---------------------------------------------------------------------------
MSG_BAD_DAYS = "Prediction days must be between 1 and 90."
MSG_NOT_ENOUGH = "Not enough historical data for {ticker} (need at least {need} days)."
MSG_NOT_ENOUGH_BACKTEST = "Not enough historical data to perform backtest (need {need} days)."
MSG_NO_FORECAST = "Model failed to generate a parsable forecast."
MSG_LOOSE_PARSE = "Could not parse forecast."
# not a reference message: the strict backtest option's own error text
MSG_LENGTH_MISMATCH = "Forecast has {f} prices but the holdout has {a}."
INITIAL_SUMMARY = "No significant trend observed yet."
NO_NEWS_SUMMARY = "No recent news found to analyze."
STATUS_OK = "Success"
STATUS_FAIL = "Failure"
UNRELIABLE_WARNING = (
    "\n\n**IMPORTANT:** The quantitative model's forecast was flagged as potentially "
    "unreliable due to statistically unlikely price jumps. Address this uncertainty "
    "in your analysis."
)

# ---------------------------------------------------------------------------
# FIXED VALUES -- prompt templates (byte for byte)
# ---------------------------------------------------------------------------
TRAINING_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "You are a financial analyst specializing in time series forecasting.\n"
    "Now, perform the following task.\n"
    "TASK: Time Series Forecast.\n"
    "STOCK: {ticker}\n"
    "STATISTICS: mean={mean}, std_dev={std_dev}, trend={trend}\n"
    "CONTEXT_DAYS: {context_days}\n"
    "DATA: [{context}]\n"
    "Predict the next {pred_days} closing prices.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "PREDICTION: [{target}]<|eot_id|>"
)

# Training prompt of the fixed-window notebook variant (static example inside).
FIXED_WINDOW_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "\n"
    "You are a financial analyst specializing in time series forecasting.\n"
    "\n"
    "Below is an example of a forecast.\n"
    "---\n"
    "EXAMPLE:\n"
    "TASK: Time Series Forecast.\n"
    "STOCK: AAPL\n"
    "STATISTICS: mean=175.30, std_dev=5.40, trend=upward\n"
    "CONTEXT_DAYS: 3\n"
    "DATA: [170.10, 172.50, 176.80]\n"
    "Predict the next 2 closing prices.\n"
    "\n"
    "PREDICTION: [178.20, 177.90]\n"
    "---\n"
    "\n"
    "Now, perform the following task.\n"
    "\n"
    "TASK: Time Series Forecast.\n"
    "STOCK: {ticker}\n"
    "STATISTICS: mean={mean}, std_dev={std_dev}, trend={trend}\n"
    "CONTEXT_DAYS: {context_days}\n"
    "DATA: [{context}]\n"
    "Predict the next {pred_days} closing prices.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "\n"
    "PREDICTION: [{target}]<|eot_id|>"
)

# Plain inference prompt (no answer), used by the exploration notebook.
PLAIN_INFERENCE_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "TASK: Time Series Forecast.\n"
    "STOCK: {ticker}\n"
    "STATISTICS: mean={mean}, std_dev={std_dev}, trend={trend}\n"
    "CONTEXT_DAYS: {context_days}\n"
    "DATA: [{context}]\n"
    "Predict the next {pred_days} closing prices.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "PREDICTION:"
)

# Serving inference prompt (analyse and backtest).
SERVING_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "        You are a financial analyst... Based on your comprehensive analysis summarized as: \"{summary}\", perform the following task.\n"
    "\n"
    "        TASK: Time Series Forecast.\n"
    "        STOCK: {ticker}\n"
    "        LAST_PRICE: {last_price}\n"
    "        STATISTICS: mean={mean}, std_dev={std_dev}, trend={trend}\n"
    "        CONTEXT_DAYS: {context_days}\n"
    "        DATA: [{context}]\n"
    "        Predict the next {pred_days} closing prices.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "        PREDICTION:"
)

# Backtest prompt of the draft with an in-series one-shot example.
ONE_SHOT_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "        You are a financial analyst specializing in time series forecasting.\n"
    "\n"
    "        Below is an example of a forecast.\n"
    "        ---\n"
    "        EXAMPLE:\n"
    "        TASK: Time Series Forecast.\n"
    "        STOCK: {ticker}\n"
    "        CONTEXT_DAYS: 60\n"
    "        DATA: [{example_context}]\n"
    "        Predict the next {pred_days} closing prices.\n"
    "\n"
    "        PREDICTION: [{example_target}]\n"
    "        ---\n"
    "\n"
    "        Now, perform the following task.\n"
    "\n"
    "        TASK: Time Series Forecast.\n"
    "        STOCK: {ticker}\n"
    "        STATISTICS: mean={mean}, std_dev={std_dev}, trend={trend}\n"
    "        CONTEXT_DAYS: {context_days}\n"
    "        DATA: [{context}]\n"
    "        Predict the next {pred_days} closing prices.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "        PREDICTION:"
)

SUMMARIZER_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "    You are a financial analyst. Your task is to update a rolling summary of a stock's history with new data. You will be given the data in small chunks to make sure each piece of context is analysed correctly then recursively fed your own output till you end up with the final chunk output which will then be saved as natural language context for time series analysis.\n"
    "    --- OUTPUT RULES ---\n"
    "    1. The output MUST be a concise, natural language sentence or short paragraph.\n"
    "    2. DO NOT output a list of numbers or raw prices.\n"
    "    3. Describe the key behavior in the NEW_DATA_CHUNK, such as the trend (upward, downward, stable), volatility (high, low), and any significant price levels tested or broken.\n"
    "    --- END RULES ---\n"
    "    Now, perform the task described.\n"
    "    PRIOR_SUMMARY: {prior}\n"
    "    NEW_DATA_CHUNK: [{chunk}]\n"
    "    UPDATED_SUMMARY:<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "    "
)

LABEL_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "Analyze the financial headline. Provide its sentiment score from -1.0 (very negative) to 1.0 (very positive) and predict the stock's percentage change for the next trading day.\n"
    "Respond in the format: SENTIMENT_SCORE: [score], NEXT_DAY_PRICE_CHANGE: [change]%\n"
    "HEADLINE: {headline}<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
)

SENTIMENT_SAMPLE = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "    Analyze the financial headline. Provide its sentiment score from -1.0 to 1.0 and predict the stock's percentage change for the next trading day.\n"
    "    HEADLINE: {headline}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "    SENTIMENT_SCORE: {score}, NEXT_DAY_PRICE_CHANGE: {change}%<|eot_id|>"
)

HEADLINE_LINE = "'{title}' (Sentiment: {label}, Score: {score})"

SENTIMENT_SYNTHESIS_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "            Analyze the following list of recent, pre-analyzed headlines for the stock {ticker}.\n"
    "            Synthesize the key themes and overall sentiment from these headlines into a concise 2-3 sentence paragraph.\n"
    "\n"
    "            PRE-ANALYZED HEADLINES:\n"
    "            {headlines}\n"
    "\n"
    "            CONCISE SENTIMENT SUMMARY:<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
)

ANALYST_REPORT_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "        You are a senior financial analyst. Your task is to write a professional investor report for the stock **{ticker}**.\n"
    "        Critically analyze the data provided.{warning}\n"
    "\n"
    "        **CONTEXT:**\n"
    "        - The most recent closing price for {ticker} is **${last_price}**.\n"
    "\n"
    "        **DATA TO SYNTHESIZE:**\n"
    "        1.  **Quantitative Model Forecast:** The price forecast for the next {pred_days} days is {forecast}.\n"
    "        2.  **Qualitative News Sentiment:** The recent news sentiment is summarized as: \"{sentiment}\".\n"
    "\n"
    "        Based on all of this information, write a concise, professional report.\n"
    "        - **Crucially, evaluate the model's forecast. Is it bullish, bearish, or neutral compared to the most recent actual price?**\n"
    "        - Provide a concluding summary of the likely outlook for **{ticker}**.\n"
    "        - Do not use generic placeholders.\n"
    "\n"
    "        ANALYST REPORT:<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
)

REVIEW_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "        You are a lead data scientist reviewing the performance of a multi-agent AI forecasting pipeline. Your task is to write a **Test Performance Review**.\n"
    "        You have the following information:\n"
    "        - **Stock:** {ticker}\n"
    "        - **Original AI Analyst Report:** \"{report}\"\n"
    "        - **AI's Price Forecast:** {forecast}\n"
    "        - **Actual Outcome (Ground Truth):** {actual}\n"
    "        - **Forecast Error Metrics:**   - Mean Absolute Error (MAE): ${mae} (Average dollar error)\n"
    "        - Root Mean Squared Error (RMSE): ${rmse} (Penalizes large errors more)\n"
    "        - Mean Absolute Percentage Error (MAPE): {mape}%\n"
    "        - Directional Accuracy: {da}% (Correctly predicted up/down trend)\n"
    "        - **News Sentiment Summary Used:** \"{sentiment}\"\n"
    "\n"
    "        **Instructions for your review:**\n"
    "        1. Start with a clear verdict: Did the pipeline perform well, poorly, or moderately?\n"
    "        2. Critique the AI's price forecast. How did it compare to the actual outcome? Did it predict the trend correctly?\n"
    "        3. Critique the original AI analyst report. Was its assessment (bullish/bearish/neutral) correct in hindsight? Did it correctly identify the risks?\n"
    "        4. Provide a concluding summary on the pipeline's overall performance for this specific test case.\n"
    "        TEST PERFORMANCE REVIEW:<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
)

# Zero-shot labelling prompt that asks for the score only.
SCORE_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "On a scale from -1.0 (extremely negative) to 1.0 (extremely positive), what is the sentiment of this financial headline? Respond with only the number.\n"
    "HEADLINE: {headline}\n"
    "SENTIMENT_SCORE:<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
)

# Report prompt of the exploration notebook, and the data that goes into it.
EXPLORATION_DATA = "\nPrice Forecast for {ticker} (next {pred_days} days): {forecast}\n\nRecent News Analysis:\n{analyses}"
EXPLORATION_ANALYSIS = "- {analysis}\n"
EXPLORATION_REPORT_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "You are a senior financial analyst. Synthesize the following quantitative forecast and qualitative news analysis into a concise, professional report for an investor.\n"
    "Do not just list the data. Provide a concluding summary of the likely outlook for the stock.\n"
    "\n"
    "--- DATA ---\n"
    "{data}\n"
    "--- END DATA ---\n"
    "\n"
    "ANALYST REPORT:<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
)

# Forecast prompts of the draft: with the folded summary, and without where no summary could be parsed.
DRAFT_SUMMARY_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "        You are a financial analyst specializing in time series forecasting.\n"
    "        Based on your comprehensive analysis summarized as: \"{summary}\", perform the following task.\n"
    "\n"
    "        TASK: Time Series Forecast.\n"
    "        STOCK: {ticker}\n"
    "        STATISTICS: mean={mean}, std_dev={std_dev}, trend={trend}\n"
    "        CONTEXT_DAYS: {context_days}\n"
    "        DATA: [{context}]\n"
    "        Predict the next {pred_days} closing prices.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "        PREDICTION:"
)
DRAFT_FALLBACK_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    "            You are a financial analyst specializing in time series forecasting. Now, perform the following task.\n"
    "            TASK: Time Series Forecast.\n"
    "            STOCK: {ticker}\n"
    "            STATISTICS: mean={mean}, std_dev={std_dev}, trend={trend}\n"
    "            CONTEXT_DAYS: {context_days}\n"
    "            DATA: [{context}]\n"
    "            Predict the next {pred_days} closing prices.<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    "            PREDICTION:"
)
FALLBACK_SUMMARY = "[Fallback Activated] Using simple 180-day context."

# Regular expressions used by the parsers and tag extractors.
RE_DRAFT_SUMMARY = r"UPDATED_SUMMARY:(.*?)PREDICTION:"
RE_PRICE = r"(\d+\.?\d*)"
RE_PRICE_LOOSE = r"[\d\.]+"
RE_SENTIMENT = r"SENTIMENT_SCORE:\s*(-?\d+\.\d+)"
RE_NEXT_CHANGE = r"NEXT_DAY_PRICE_CHANGE:\s*(-?\d+\.\d+)%"
RE_STOCK_TAG = r"STOCK: (\S+)"
RE_CONTEXT_TAG = r"CONTEXT_DAYS: (\d+)"
PREDICTION_MARKER = "PREDICTION:"
