"""Schemas of the tables that the pipeline exchanges. Frames, positions, states and beats count from 1."""

FILES = "file_id long, path string, dataset string"
FRAMES = "file_id long, frame long, dim int, value double"
BEATS = "file_id long, beat_idx long, t double, bar long, beat_no long"
METERS = "file_id long, num int, den int"
BARS = "file_id long, bar_no long, beat_idx long, t0 double, t1 double"
CELLS = "file_id long, bar_no long, cell int, dim int, value double"
PATTERNS = "pattern int, name string, num int, den int, n_beats int, prior double"
STATES = "state int, pattern int, tempo_idx int, frames_per_beat int, pos_idx int, position double, tempo double"
TRANSITIONS = "i int, j int, p double"
GMM = "pattern int, cell int, comp int, weight double, mu array<double>, cov array<double>"
PATH = "file_id long, frame long, state int"
RESULT_BEATS = "file_id long, frame double, t double, beat_no int"
