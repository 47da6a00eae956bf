"""The order in which DuckDB's list_grade_up leaves equal elements: branchless pattern-defeating quicksort, stable below 24 elements only.

``arrays.sort_indices`` keeps equal elements by index; this is for results that must equal SQL where it leaves their order open.
Held against DuckDB 2.0 for lists of up to 99 numbers without null and NaN.  The fallback to heap sort after many bad partitions is not built.
"""

from __future__ import annotations


def order(values: list[float] | None) -> list[int] | None:
    """Indices of the values in ascending order, equal ones as the sort leaves them; null for null."""
    if values is None:
        return None
    v=[(x,i) for i,x in enumerate(values)]
    lt=lambda p,q: p[0]<q[0]
    def ins(b,e):
        for cur in range(b+1,e):
            t=v[cur]; k=cur
            while k>b and lt(t,v[k-1]): v[k]=v[k-1]; k-=1
            v[k]=t
    def pins(b,e):
        if b==e: return True
        lim=0
        for cur in range(b+1,e):
            if lt(v[cur],v[cur-1]):
                t=v[cur]; k=cur
                while k>b and lt(t,v[k-1]): v[k]=v[k-1]; k-=1
                v[k]=t; lim+=cur-k
            if lim>8: return False
        return True
    def s2(a,b):
        if lt(v[b],v[a]): v[a],v[b]=v[b],v[a]
    def s3(a,b,c): s2(a,b); s2(b,c); s2(a,b)
    def sw(a,b): v[a],v[b]=v[b],v[a]
    def right(b,e):
        p=v[b]; f=b; l=e
        f+=1
        while lt(v[f],p): f+=1
        if f-1==b:
            while f<l:
                l-=1
                if lt(v[l],p): break
        else:
            l-=1
            while not lt(v[l],p): l-=1
        done=f>=l
        if not done:
            sw(f,l); f+=1
            # blocks of 64: with fewer than 128 left both sides are split by half
            L=[];R=[];lb=f;rb=l;nl=nr=0;sl=sr=0
            while f<l:
                unk=l-f
                ls=(unk//2 if nr==0 else unk) if nl==0 else 0
                rs=(unk-ls) if nr==0 else 0
                if nl==0 and ls>=64 : ls=64
                if ls:
                    L=[];sl=0
                    for k in range(ls):
                        if not lt(v[f],p): L.append(k)
                        f+=1
                    nl=len(L); 
                if rs:
                    rs=min(rs,64); R=[];sr=0
                    for k in range(rs):
                        l-=1
                        if lt(v[l],p): R.append(k+1)
                    nr=len(R)
                n=min(nl,nr)
                if n:
                    if nl==nr:
                        for k in range(n): sw(lb+L[sl+k], rb-R[sr+k])
                    else:
                        x=lb+L[sl]; y=rb-R[sr]; t=v[x]; v[x]=v[y]
                        for k in range(1,n):
                            x=lb+L[sl+k]; v[y]=v[x]; y=rb-R[sr+k]; v[x]=v[y]
                        v[y]=t
                nl-=n;nr-=n;sl+=n;sr+=n
                if nl==0: sl=0; lb=f
                if nr==0: sr=0; rb=l
            if nl:
                while nl: nl-=1; l-=1; sw(lb+L[sl+nl],l)
                f=l
            if nr:
                while nr: nr-=1; sw(rb-R[sr+nr],f); f+=1
                l=f
        q=f-1; v[b]=v[q]; v[q]=p
        return q,done
    def left(b,e):
        p=v[b]; f=b; l=e-1
        while lt(p,v[l]): l-=1
        if l+1==e:
            while f<l:
                f+=1
                if lt(p,v[f]): break
        else:
            f+=1
            while not lt(p,v[f]): f+=1
        while f<l:
            sw(f,l)
            l-=1
            while lt(p,v[l]): l-=1
            f+=1
            while not lt(p,v[f]): f+=1
        v[b]=v[l]; v[l]=p
        return l
    def loop(b,e,leftmost=True):
        while True:
            n=e-b
            if n<24: ins(b,e); return
            h=n//2
            if n>128:
                s3(b,b+h,e-1); s3(b+1,b+h-1,e-2); s3(b+2,b+h+1,e-3); s3(b+h-1,b+h,b+h+1); sw(b,b+h)
            else: s3(b+h,b,e-1)
            if not leftmost and not lt(v[b-1],v[b]): b=left(b,e)+1; continue
            q,done=right(b,e); l=q-b; r=e-q-1
            if l<n//8 or r<n//8:
                if l>=24:
                    sw(b,b+l//4); sw(q-1,q-l//4)
                    if l>128: sw(b+1,b+l//4+1); sw(b+2,b+l//4+2); sw(q-2,q-(l//4+1)); sw(q-3,q-(l//4+2))
                if r>=24:
                    sw(q+1,q+1+r//4); sw(e-1,e-r//4)
                    if r>128: sw(q+2,q+2+r//4); sw(q+3,q+3+r//4); sw(e-2,e-(1+r//4)); sw(e-3,e-(2+r//4))
            elif done and pins(b,q) and pins(q+1,e): return
            loop(b,q,leftmost); b=q+1; leftmost=False
    loop(0,len(v))
    return [i for _,i in v]
