"""Operators that prepare large text corpora for training.

Nothing outside this package imports it.  Shared conventions:

* a null text counts as the empty text; a null ``doc_id`` is a value of its own
  where rows are scored one by one, and see each operator where rows are linked;
* repeated rows are separate rows with equal results;
* an id that comes with several texts is several documents: each row is judged by its
  own text, and where ids stand for documents (the least id of a class, the largest
  that keeps a line) the id counts once; `jaccard.keep_one` tells rows apart by id and set;
* ties go to the least id, place or name, as each operator says;
* extra columns never take part, whatever their names; operators that return
  documents hand them through;
* an empty table gives an empty result with the documented columns.
"""
